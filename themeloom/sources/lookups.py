"""Fixed code lists of the domain."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Topics of the 100-topic model read as sustainability themes.
SUSTAINABILITY = {
    "V7": "fornybar",
    "V10": "samf",
    "V11": "deling",
    "V21": "transport",
    "V33": "materialer",
    "V44": "plast",
    "V61": "tekstil",
    "V80": "vann",
}

# Topics of that model read as themes of the fourth industrial revolution.
INDUSTRY_FOUR = {
    "V5": "datascience",
    "V34": "bildegjenkjenning",
    "V38": "droner",
    "V57": "digitaleplattformer",
    "V65": "kunstigintelligens",
    "V73": "data",
    "V79": "biologisk",
    "V81": "delingsokonomi",
    "V85": "robotisering",
}

# Themes of that kind that are averaged into one.
INDUSTRY_FOUR_MERGED = {
    "kunstigintelligens": ["kunstigintelligens", "datascience"],
    "digitaleplattformer": ["digitaleplattformer", "delingsokonomi"],
    "fysiskegjenstander": ["droner", "bildegjenkjenning"],
}

# Display labels.
THEME_LABELS = {
    "fornybar": "Fornybar energi",
    "samf": "Samfunnsansvar og utvikling",
    "deling": "Bil, utslipp og energi",
    "transport": "Energi og utslipp",
    "materialer": "Materialer",
    "plast": "Marin forurensing",
    "tekstil": "Gjenbruk og bytte",
    "vann": "Rensing av vann og luft",
    "biologisk": "Biologisk",
    "data": "Data",
    "digitaleplattformer": "Digitale plattformer",
    "fysiskegjenstander": "Fysiske gjenstander",
    "kunstigintelligens": "Kunstig intelligens",
    "robotisering": "Robotisering",
}

# County numbers up to 2019.
COUNTIES = {
    "01": "Ostfold",
    "02": "Akershus",
    "03": "Oslo",
    "04": "Hedemark",
    "05": "Oppland",
    "06": "Buskerud",
    "07": "Vestfold",
    "08": "Telemark",
    "09": "Aust Agder",
    "10": "Vest Agder",
    "11": "Rogaland",
    "12": "Hordaland",
    "14": "Sogn og Fjordane",
    "15": "More og Romsdal",
    "16": "Sor Trondelag",
    "17": "Nord Trondelag",
    "18": "Nordland",
    "19": "Troms",
    "20": "Finnmark",
    "50": "Trondelag",
}

# First and last two-digit industry code of each sector.
SECTOR_RANGES = [
    (1, 3, "Jordbruk"),
    (5, 9, "Bergverksdrift og utvinning"),
    (10, 33, "Industri"),
    (35, 35, "Elektrisitets-, gass-, damp- og varmtvannsforsyning"),
    (36, 39, "Vannforsyning, avlops- og renovasjonsvirksomhet"),
    (41, 43, "Bygge og anleggsvirksomhet"),
    (45, 47, "Varehandel, reparasjon av motorvogner"),
    (49, 53, "Transport og lagring"),
    (55, 56, "Overnatting og servicevirksomhet"),
    (58, 63, "Informasjon og kommunikasjon"),
    (64, 66, "Finansierings- og forsikringsvirksomhet"),
    (68, 68, "Omsetning og drift av fast eiendom"),
    (69, 75, "Faglig, vitenskapelig og teknisk tjenesteyting"),
    (77, 82, "Forretningsmessig tjenesteyting"),
    (84, 84, "Offentlig administrasjon og forsvar"),
    (85, 85, "Undervisning"),
    (86, 88, "Helse og omsorgstjenester"),
    (90, 93, "Kulturell virksomhet, underholdning og fritidsaktiviteter"),
    (94, 96, "Annen tjenesteyting"),
    (97, 97, "Lønnet arbeid i private husholdninger"),
    (99, 99, "Internasjonale organisasjoner og organer"),
]


def sectors() -> dict[str, str]:
    return {f"{code:02d}": name for first, last, name in SECTOR_RANGES for code in range(first, last + 1)}


def as_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """Mapping as a local table (code, label)."""
    columns = {"code": list(mapping), "label": list(mapping.values())}
    return spark.createDataFrame(pa.table(columns, schema=pa.schema([("code", pa.string()), ("label", pa.string())])))


def stopwords(spark: SparkSession, languages=("norwegian", "swedish", "english")) -> DataFrame:
    """Stop words shipped with Spark ML, a table with the column `word`."""
    from pyspark.ml.feature import StopWordsRemover

    words = sorted({w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)})
    return spark.createDataFrame(pa.table({"word": words}))
