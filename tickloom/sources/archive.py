"""Archive rows, user datasets and user series as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.parsing import epoch_ms, num

from .paths import classify, day_of, for_run

RESERVED = ["kind", "name", "ts_ms"]
# Names under which a series' time may come.
TIME_NAMES = ["ts_ms", "ts", "time", "timestamp", "date", "datetime", "open_time"]


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; every cell stays a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("recursiveFileLookup", True).csv(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; blank and malformed lines drop out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, day and partition columns) of every file below ``path``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    relative = F.regexp_extract("path", r"((?:data|derived)/.*)$", 1)
    return classify(found.withColumn("rel", relative), "rel").withColumn("day", day_of(F.col("rel")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of files with file and line: numbered within each split of a file, and the splits before it are added."""
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), *rows.columns)
    sizes = rows.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # a split is read in order by one task, so its rows' ids grow
    own = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_id")) - 1
    numbered = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_own", own)
    return numbered.join(sizes, ["file", "_split"]).withColumn("line", F.col("_before") + F.col("_own")).drop("_split", "_id", "_own", "_before")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): text lines in an order that doesn't depend on splits: byte order of paths, then the line's number from 0.

    A large file is read by many tasks. Blank lines count, but drop out.
    """
    return _numbered(spark.read.text(path, recursiveFileLookup=True)).select("file", "line", "value").where(F.trim("value") != "")


# The cells of feed rows that events are read from, and the fields of venue records.
FEED_CELLS = ["condition_id", "market_id", "slug", "category_slug", "asset_id", "asset", "price_feed_id", "event_ts_ms", "update_ts_ms", "feed_ts_ms", "ts_ms", "timestamp_ms", "publish_time", "value", "price", "answer", "size", "side",
              "best_bid", "best_ask", "asks", "bids", "price_changes", "payload"]
MARKET_ROWS = {
    "polymarket": "condition_id string, slug string, asset string, interval_sec bigint, strike_value string, resolved boolean, outcome_prices array<string>, start_sec bigint, end_sec bigint, token_ids array<string>, "
                  "raw struct<cryptoMarketConfig:struct<twapLookbackSeconds:int>,feesEnabled:boolean,feeSchedule:struct<rate:double,exponent:int>>",
    "predict": "market_id string, category_slug string, asset string, interval_label string, start_price string, end_price string, start_sec bigint, end_sec bigint, price_feed_id bigint"}
DATASET_OF = {"polymarket": {"books": "book", "changes": "price_change", "bounds": "best_bid_ask", "trades": "last_trade_price"}, "predict": {"orderbooks": "orderbook"}}
IDS = {"polymarket": ("condition_id", "slug"), "predict": ("market_id", "category_slug")}


def day_files(spark: SparkSession, root: str, day: str, venue: str, datasets: list[str], assets: list[str] = (), intervals: list[str] = ()) -> DataFrame:
    """The files of a day that a run reads, from their paths alone; see ``for_run``."""
    return for_run(files(spark, root).where(F.col("day") == day), venue, list(assets), list(datasets), list(intervals))


def feed_rows(spark: SparkSession, found: DataFrame) -> DataFrame | None:
    """Rows of JSON lines and CSV ``found`` (path, rel, asset), every cell a string, with seq: byte order of paths, then lines. None without files.

    Only these files are opened. The paths of one dataset and day go through the driver, as for any listing. The CSV files of a
    dataset share their header. ``asset`` comes from the path where the row has none.
    """
    listed = found.select("path", "asset").orderBy("path").collect()
    csv = [r.path for r in listed if r.path.endswith((".csv", ".csv.gz"))]
    lines = [r.path for r in listed if r.path not in set(csv)]
    out = None
    if lines:
        raw = numbered_lines(spark, lines)
        out = raw.select("file", "line", *[F.get_json_object("value", f"$.{c}").alias(c) for c in FEED_CELLS])
    if csv:
        rows = _numbered(spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(csv))
        rows = rows.select("file", "line", *[c for c in rows.columns if c in FEED_CELLS])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return None
    place = spark.createDataFrame([(r.path, i, r.asset) for i, r in enumerate(listed)], "file string, _file bigint, _asset string")
    rows = out.join(place, "file")
    seq = F.shiftleft("_file", 40) + F.col("line")
    asset = F.coalesce("asset", "_asset") if "asset" in rows.columns else F.col("_asset")
    return rows.withColumns({"asset": asset, "seq": seq}).drop("_file", "_asset", "file", "line")


def load_day(spark: SparkSession, root: str, day: str, venue: str = "polymarket", datasets: list[str] = ("settlement", "book", "trades", "best_bid_ask"), assets: list[str] = (), intervals: list[str] = (), throttles: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(markets, events) of one day of an archive below ``root``.

    Markets are the last records of each id in the day's listing, of the assets and intervals that are asked for.
    Events are those of ``day_events``; settlement feeds are those that some market settles on. With ``spot`` among
    ``datasets`` the venue's prices are events of their own. Files are chosen by their paths: others aren't opened.
    """
    from tickloom.operators import decode
    from tickloom.plans.data import SETTLEMENT_STREAMS, physical_datasets

    wanted = [d for d in physical_datasets(list(datasets)) if d != "spot"]
    index = day_files(spark, root, day, venue, [*wanted, "markets", *SETTLEMENT_STREAMS], assets, intervals)
    of = lambda name: index.where(F.col("dataset") == name)
    id_column, slug_column = IDS[venue]
    listing = [r.path for r in of("markets").select("path").orderBy("path").collect()]
    rows = numbered_lines(spark, listing) if listing else spark.createDataFrame([], "file string, line bigint, value string")
    rows = rows.select("file", "line", F.from_json("value", MARKET_ROWS[venue]).alias("r")).select("file", "line", "r.*")
    records = decode.latest_by_id(rows, id_column, ["file", "line"])
    markets = (decode.polymarket_records if venue == "polymarket" else decode.predict_records)(records)
    for column, want in (("asset", [a.upper() for a in assets]), ("interval", list(intervals))):
        if want:
            markets = markets.where(F.col(column).isNull() | F.upper(column).isin([w.upper() for w in want]))
    streams = [r.stream for r in markets.where("stream IS NOT NULL").select("stream").distinct().collect()] if "settlement" in datasets else []
    prices = {s: feed for s in streams if (feed := feed_rows(spark, of(s))) is not None}
    feeds = {name: feed_rows(spark, of(tree)) for name, tree in DATASET_OF[venue].items() if tree in wanted}
    spot = feed_rows(spark, of("prices")) if "spot" in datasets and venue == "polymarket" else None
    return markets, decode.day_events(markets, prices, **feeds, spot=spot, throttles=throttles, id_column=id_column, slug_column=slug_column)


def series_time_column(columns: list[str]) -> str:
    """The column that holds a series' time: the first with such a name, else the first of all."""
    return next((c for c in columns if c.strip().lower() in TIME_NAMES), columns[0])


def series(rows: DataFrame, time: str | None = None) -> DataFrame:
    """A user series: ts_ms from its time column (s, ms or us by the digits), numbers where every cell reads as one stays per cell.

    Rows without a time drop out; columns named as reserved ones are refused. Without a column of a time's name the first one
    must look like a time: whole numbers in its first row must lie between the years 2000 and 2100.
    """
    named = time or next((c for c in rows.columns if c.strip().lower() in TIME_NAMES), None)
    time = named or rows.columns[0]
    if named is None:
        sample = rows.select(F.trim(F.col(f"`{time}`").cast("string")).alias("x"), epoch_ms(F.col(f"`{time}`")).alias("ms")).head()
        if sample and sample.x and sample.x.isdigit() and not 946_684_800_000 < (sample.ms or 0) < 4_102_444_800_000:
            raise ValueError(f"no column holds times: {time} doesn't look like one")
    clash = [c for c in rows.columns if c in RESERVED and c != time]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    cell: list[Column] = [F.struct(num(F.col(f"`{c}`")).alias("number"), F.col(f"`{c}`").alias("text")).alias(c) for c in rows.columns if c != time]
    return rows.select(epoch_ms(F.col(f"`{time}`")).alias("ts_ms"), *cell).where("ts_ms IS NOT NULL")


def event_lines(lines: DataFrame, drop_trades: bool = False, column: str = "value") -> DataFrame:
    """Cached event lines, trimmed, without blank ones; with ``drop_trades`` those of trades drop out by how they begin, unparsed."""
    out = lines.withColumn(column, F.regexp_replace(column, r"^\s+|\s+$", "")).where(F.col(column) != "")
    return out.where(~F.col(column).startswith('{"kind":"trade"')) if drop_trades else out
