"""Bars from CSV files, with the rows that break a rule set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality
from .errors import Corruption, InvalidArgument

TIMES = ("timeopen", "timestamp", "date", "time")  # the first of them that a file has
COLUMNS = ("open", "high", "low", "close")
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd")


def epoch_ns(text: Column) -> Column:
    """Nanoseconds of an ISO 8601 date or time; a zone or offset after it plays no part, and what is neither is null."""
    t = F.regexp_replace(F.trim(text), r"(\.\d{3})\d*|(Z|[+-]\d\d:?\d\d)$", "$1")
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])
    return F.unix_micros(parsed) * 1000


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of the files as they are: symbol (a column or folder of that name, else the file's name up to the first `_`), timestamp_ns, open..volume, market_cap, broken, raw.

    The separator is `;`, or `,` where the header has none. Names match in any case. `broken` names the rules that a row breaks
    (`time` and `number` for what cannot be read), comma-joined; files are split and read in parallel. All files share the first file's columns.
    """
    paths = [paths] if isinstance(paths, str) else paths
    lines = spark.read.text(paths).limit(1).collect()
    if not lines:
        raise InvalidArgument("no header")
    sep = ";" if ";" in lines[0].value else ","
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", False).csv(paths)
    names = {c.strip().strip('"').lower(): c for c in raw.columns}
    time = next((names[t] for t in TIMES if t in names), None)
    missing = [c for c in COLUMNS if c not in names] + ([] if time else ["time"])
    if missing:
        raise InvalidArgument(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.regexp_replace(F.col(f"`{names[c]}`"), '"', ""))
    number = lambda c: text(c).try_cast("double") if c in names else F.lit(0.0)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    out = raw.select(
        (F.col("symbol").cast("string") if "symbol" in raw.columns else F.substring_index(stem, "_", 1)).alias("symbol"), epoch_ns(F.col(f"`{time}`")).alias("timestamp_ns"), *[number(c).alias(c) for c in COLUMNS], number("volume").alias("volume"),
        number("marketcap").alias("market_cap"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("raw"),
    )
    broken = F.concat_ws(",", F.when(F.col("timestamp_ns").isNull(), "time"), *[F.when(c, F.lit(k)) for k, c in quality.rules().items()])
    return out.withColumn("broken", broken)


def bars(rows: DataFrame, resolution_ms: int = 86_400_000, quarantine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(bars of the good rows, rows set aside). Without quarantine, a broken row fails the job that meets it.

    symbol_id numbers the symbols from 1; buy and sell volume are half each and vwap the mean price, as files have no trades.
    """
    good, bad = rows.where("broken = ''"), rows.where("broken <> ''")
    if not quarantine:
        good = rows.where(F.when(F.col("broken") == "", True).otherwise(F.raise_error(F.concat(F.lit("broken row: "), F.col("broken"), F.lit(" "), F.col("raw"))).cast("boolean")))
    symbols = [r.symbol for r in rows.select("symbol").distinct().orderBy("symbol").limit(1_000_001).collect()]  # one for each file at most
    if len(symbols) > 1_000_000:
        raise InvalidArgument("more than 1000000 symbols")
    ids = rows.sparkSession.createDataFrame(list(zip(symbols, range(1, len(symbols) + 1))), "symbol string, symbol_id int")
    half = F.col("volume") * 0.5
    out = good.join(F.broadcast(ids), "symbol").select(
        "symbol", F.col("timestamp_ns").alias("bar_timestamp_ns"), "symbol_id", F.lit(resolution_ms).alias("resolution_ms"), *COLUMNS, "volume",
        ((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).alias("vwap"), F.lit(1).cast("long").alias("tick_count"), half.alias("buy_volume"), half.alias("sell_volume"),
    )
    return out, bad


def write(good: DataFrame, path: str) -> None:
    """Parquet by symbol and year."""
    year = F.year(F.timestamp_micros(F.floor(F.col("bar_timestamp_ns") / 1000)))
    good.withColumn("year", year).repartition("symbol", "year").sortWithinPartitions("bar_timestamp_ns").write.partitionBy("symbol", "year").parquet(path)


def report(rows: DataFrame) -> dict[str, int]:
    """Rows read, good and set aside, and how many break each rule; a file set without a good row is refused."""
    names = ["time", *quality.rules()]
    has = lambda k: F.array_contains(F.split("broken", ","), k)
    r = rows.agg(F.count("*").alias("read"), F.count_if(F.col("broken") == "").alias("good"), F.count_if(F.col("broken") != "").alias("set_aside"), *[F.count_if(has(k)).alias(k) for k in names]).head().asDict()
    if not r["good"]:
        raise Corruption("no valid row")
    return r


def regressions(rows: DataFrame) -> DataFrame:
    """(file, regressions): how often a row's time lies before that of the row above it in its file. Such rows are counted, not set aside.

    rows: `read`'s with the columns file and place (see `in_file_order`); a file's rows are taken in order of place.
    """
    before = F.lag("timestamp_ns").over(Window.partitionBy("file").orderBy("place"))
    return rows.withColumn("back", F.col("timestamp_ns") < before).groupBy("file").agg(F.count_if("back").alias("regressions"))


def in_file_order(raw: DataFrame) -> DataFrame:
    """Adds file and place, the row's number in file order: parts of a file are read in order of their start, and rows in order within a part."""
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))


def read_each(spark: SparkSession, paths: list[str], read_one) -> tuple[DataFrame | None, dict[str, str]]:
    """Every path read by itself with read_one(path); those that fail are left out and given with their errors. Paths are files of one import, not rows."""
    good, failed = [], {}
    for path in paths:
        try:
            df = read_one(path)
            df.limit(1).collect()
            good.append(df)
        except Exception as e:
            failed[path] = str(e).splitlines()[0]
    out = None
    for df in good:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed
