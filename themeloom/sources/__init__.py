from themeloom.sources.scan import (
    APPLICATION_SCHEMA,
    REGISTRY_SCHEMA,
    cut_lineage,
    read_applications,
    read_loadings,
    read_registry,
    save_stage,
)

__all__ = [
    "APPLICATION_SCHEMA",
    "REGISTRY_SCHEMA",
    "cut_lineage",
    "read_applications",
    "read_loadings",
    "read_registry",
    "save_stage",
]
