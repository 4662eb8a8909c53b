"""Transaction sources: CSV and parquet, the schema contract, and one rule for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns that every transaction table must have.
REQUIRED_COLUMNS = (
    "TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "ProductCD",
    "card1", "card2", "card3", "card5", "addr1", "addr2", "D1",
)
#: Texts that mean "missing" in CSV files.
NA_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "NULL", "null", "None", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN")
TYPES = {"TransactionID": "bigint", "TransactionDT": "bigint", "isFraud": "int", "ProductCD": "string", "DeviceInfo": "string", "id_31": "string", "DeviceType": "string"}
TEXT_PREFIXES = ("id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30", "id_33", "id_34", "id_35", "id_36", "id_37", "id_38", "card4", "card6", "P_emaildomain", "R_emaildomain", "M")


def validate_schema(df: DataFrame) -> None:
    """Raises ValueError with the sorted names of required columns that are absent. Runs no job."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float column with NaN turned into null; downstream code knows null only."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def column_type(name: str) -> str:
    if name in TYPES:
        return TYPES[name]
    return "string" if name.startswith(TEXT_PREFIXES) and not name[:1].isdigit() else "double"


def require_path(spark: SparkSession, path: str) -> None:
    """Raises FileNotFoundError unless Spark's file system has the path (or a match of its pattern)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise FileNotFoundError(f"no input at {path}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, each column of its declared type (no pass over the data to infer), NA texts as null."""
    require_path(spark, path)
    header = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)

    def clean(c: str):
        kept = F.when(~F.trim(F.col(f"`{c}`")).isin(*NA_TOKENS), F.col(f"`{c}`"))
        kind = column_type(c)
        return (kept if kind == "string" else kept.cast("double").cast(kind)).alias(c)

    return nan_to_null(raw.select(*[clean(c) for c in header]))


def join_identity(transactions: DataFrame, identity: DataFrame) -> DataFrame:
    """Left join on TransactionID; repeated identity rows fan out; other shared names are an error."""
    clash = sorted((set(transactions.columns) & set(identity.columns)) - {"TransactionID"})
    if clash:
        raise ValueError(f"Columns in both inputs: {clash}")
    return transactions.join(identity, "TransactionID", "left")


def load_transactions(spark: SparkSession, transaction_path: str, identity_path: str | None = None) -> DataFrame:
    df = read_csv(spark, transaction_path)
    if identity_path is not None:
        df = join_identity(df, read_csv(spark, identity_path))
    validate_schema(df)
    return df


def read_features(spark: SparkSession, path: str) -> DataFrame:
    require_path(spark, path)
    return spark.read.parquet(path)


def write_features(df: DataFrame, path: str, as_of: str | None = None) -> None:
    """Parquet; ``as_of`` is written as ``last_updated``, which serving carries along."""
    out = df if as_of is None else df.withColumn("last_updated", F.lit(as_of).cast("timestamp"))
    out.write.mode("overwrite").parquet(path)
