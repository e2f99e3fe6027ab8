"""Report files: CSV with a byte order mark, and reproducible ZIP archives. Large tables stay Parquet."""

from __future__ import annotations

import hashlib
import json
import zipfile
import zlib
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

#: Above this many bytes an entry is compressed, if that makes it smaller.
STORE_BELOW = 256


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def csv_field(value: object) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def panel_csv(df: DataFrame, limit: int = 100_000) -> bytes:
    """A small report panel as one CSV file with a byte order mark; more than ``limit`` rows are refused."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError("too many rows for one file: write them with write_csv")
    lines = [",".join(map(csv_field, df.columns)), *(",".join(map(csv_field, r)) for r in rows)]
    return ("﻿" + "\n".join(lines) + "\n").encode()


def write_zip(path: str | Path, entries: Iterable[tuple[str, bytes]]) -> dict[str, str]:
    """A ZIP whose bytes depend on the entries alone, with their SHA-256 sums inside; the sums are returned."""
    entries = sorted(entries)
    sums = {name: hashlib.sha256(data).hexdigest() for name, data in entries}
    listed = "".join(f"{h}  {name}\n" for name, h in sums.items()).encode()
    with zipfile.ZipFile(path, "w") as out:
        for name, data in [*entries, ("sha256sums.txt", listed)]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if len(data) > STORE_BELOW and len(zlib.compress(data, wbits=-15)) < len(data) else zipfile.ZIP_STORED
            info.external_attr = 0o644 << 16
            out.writestr(info, data)
    return sums


def write_report(path: str | Path, report: dict, panels: dict[str, DataFrame], logs: str = "", coverage: dict | None = None, tables: dict[str, DataFrame] | None = None, folder: str | None = None) -> dict[str, str]:
    """A report bundle: report.json, a CSV for each small panel (calibration, markets, equity, ...), coverage.json and logs.txt in one ZIP.

    ``tables`` of any size (trades, fills) are written as folders of CSV parts below ``folder``, a path of Spark's; report.json
    names them under ``tables``. The ZIP is the same whenever its entries are; the sums of its entries are returned.
    """
    where = {name: f"{folder}/{name}" for name in sorted(tables or {})}
    for name, target in where.items():
        write_csv(tables[name], target)
    as_json = lambda x: (json.dumps(x, indent=2, ensure_ascii=False) + "\n").encode()
    entries = [("report.json", as_json({**report, "tables": where} if where else report)), ("coverage.json", as_json(coverage or {})), ("logs.txt", logs.encode())]
    return write_zip(path, [*entries, *((f"{name}.csv", panel_csv(df)) for name, df in panels.items())])


def write_events(events: DataFrame, path: str) -> None:
    """Decoded events by day and market: one shuffle by market, each market in replay order."""
    events.repartition("day", "market_id").sortWithinPartitions("day", "market_id", "ts_ms", "rank", "seq").write.mode("overwrite").partitionBy("day").parquet(path)


def write_colocated(df: DataFrame, table: str, key: str, order: Sequence[str], buckets: int) -> None:
    """A table dealt by ``key`` into ``buckets`` and sorted by it and ``order``: tables of as many buckets meet by the key without a shuffle.

    One file for each bucket. Folds, windows and joins of such tables by ``key`` read them as they lie.
    """
    rows = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
