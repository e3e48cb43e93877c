"""Sinks: partitioned stores, quarantine, ledgers with seals, inventories and reports."""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.errors import IntegrityError


def write_days(df: DataFrame, path: str, column: str = "click_day", rows_per_file: int = 1_000_000) -> None:
    """One folder per day, zstd, in files of bounded size; a day is split over as many tasks as it wants files.

    Rows are counted by day first: one number a day."""
    many = df.groupBy(column).count().where(F.col("count") > rows_per_file).collect()
    salts = F.lit(1)
    for r in many:
        salts = F.when(F.col(column).eqNullSafe(F.lit(r[column])), -(-r["count"] // rows_per_file)).otherwise(salts)
    salted = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), salts))
    salted.repartition(column, "__s").drop("__s").write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(column).mode("errorifexists").parquet(path)


def tagged(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """df whose first column carries tags, which Spark keeps with the schema in each file's footer."""
    first = df.columns[0]
    return df.withMetadata(first, dict(df.schema[first].metadata) | {"tags": json.dumps(tags, sort_keys=True)})


def tags_of(df: DataFrame) -> dict[str, str]:
    return json.loads(df.schema[0].metadata.get("tags", "{}"))


def write_accepted(validated: DataFrame, path: str, fields: list[str], sep: str = "\t") -> dict[str, int]:
    """The accepted rows' own fields as delimited text; raises unless accepted and quarantined make up what was parsed
    and the files hold all that was accepted."""
    ok = F.size("reasons") == 0
    validated.where(ok).select(*fields).write.option("sep", sep).option("quote", '"').option("emptyValue", "").mode("errorifexists").csv(path)
    n = validated.agg(F.count("*").alias("parsed"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined")).first().asDict()
    schema = ", ".join(f"`{f}` string" for f in fields)
    written = validated.sparkSession.read.schema(schema).option("sep", sep).option("quote", '"').csv(path).count()
    if n["accepted"] + n["quarantined"] != n["parsed"] or written != n["accepted"]:
        raise IntegrityError("COUNT_MISMATCH", path, written=written, **n)
    return n


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.option("compression", "zstd").mode("errorifexists").parquet(path)


def write_quarantine(validated: DataFrame, path: str) -> None:
    validated.where(F.size("reasons") > 0).select("raw_row_index", F.col("reasons").alias("reason_codes"), "failing_fields").write.option("compression", "zstd").mode("errorifexists").parquet(path)


def write_truth(truth: DataFrame, root: str, day: int, origin: int = 0) -> None:
    """Positives by the day of their reveal, negatives by that of their maturity."""
    at = F.floor((F.col("available_at") - origin) / day).cast("int")
    cols = ["click_id", "final_label", "click_time", "available_at"]
    write_days(truth.where("final_label = 1").select(*cols, at.alias("reveal_day")), f"{root}/reveal", "reveal_day")
    write_days(truth.where("final_label = 0").select(*cols, at.alias("maturity_day")), f"{root}/maturity", "maturity_day")


def canonical(value) -> bytes:
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def write_object(path: str, value, overwrite: bool = False) -> str:
    """Writes JSON at once or not at all, refuses to replace, and returns its digest."""
    data = canonical(value)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(temp, path)
        else:
            os.link(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return hashlib.sha256(data).hexdigest()


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below path, hashed where the files are."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def inventory_difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Files that are missing, not listed or changed."""
    e, g = expected.alias("e"), got.alias("g")
    d = e.join(g, F.col("e.path") == F.col("g.path"), "full_outer")
    what = F.when(F.col("g.path").isNull(), "missing").when(F.col("e.path").isNull(), "unlisted").when(F.col("e.sha256") != F.col("g.sha256"), "changed")
    return d.select(F.coalesce("e.path", "g.path").alias("path"), what.alias("difference")).where("difference is not null")


class Ledger:
    """An append-only table of parts; a part that is written again must be equal, and a seal ends it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def append(self, part: int, df: DataFrame) -> None:
        if self._exists("seal"):
            raise ValueError("the ledger is sealed")
        if part and not self._exists(f"part={part - 1}"):
            raise ValueError("parts must follow one another")
        to = f"{self.path}/part={part}"
        if self._exists(f"part={part}/_SUCCESS"):
            old = self.spark.read.parquet(to)
            if old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
                raise ValueError(f"part {part} was written with other rows")
            return
        df.write.mode("overwrite").option("compression", "zstd").parquet(to)

    def read(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", False).option("basePath", self.path).parquet(f"{self.path}/part=*")

    def digest(self) -> dict:
        from latelens.operators.protocol import ordered_digest

        d = self.read()
        row = ordered_digest(d, self.order, self.keys[0]).first()
        return {"rows": d.count(), "digest": row["digest"] if row else None}

    def seal(self) -> dict:
        d = self.read()
        if d.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError("duplicate keys")
        seal = self.digest()
        self.spark.createDataFrame([json.dumps(seal)], "string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/seal")
        return seal

    def verify(self) -> None:
        seal = json.loads(self.spark.read.text(f"{self.path}/seal").first()["value"])
        if seal != self.digest():
            raise ValueError("the ledger differs from its seal")


class ExposureLedger(Ledger):
    """A ledger with a part for each credit, each step of which saw a whole batch."""

    def __init__(self, spark: SparkSession, path: str, batch: int):
        super().__init__(spark, path, ["credit_id", "step", "draw"], ["credit_id", "step", "draw"])
        self.batch = batch

    def append(self, part: int, df: DataFrame) -> None:
        from latelens.operators.protocol import exposure_violations

        if df.where(F.coalesce(F.col("credit_id") != part, F.lit(True))).limit(1).count():
            raise IntegrityError("WRONG_CREDIT", f"part {part} holds another credit's exposures")
        if exposure_violations(df, self.batch).limit(1).count():
            raise IntegrityError("BATCH_SIZE", f"a step of credit {part} saw other than {self.batch} rows")
        super().append(part, df)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def published(spark: SparkSession, path: str, write: Callable[[str], dict | None]) -> dict | None:
    """write(folder) into a folder beside path, which takes path's name only when all is written; else it goes."""
    fs, to = _fs(spark, path)
    if fs.exists(to):
        raise IntegrityError("EXISTS", path)
    _, temp = _fs(spark, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    try:
        out = write(temp.toString())
        if not fs.rename(temp, to):
            raise IntegrityError("NOT_PUBLISHED", path)
        return out
    finally:
        fs.delete(temp, True)


def materialised(spark: SparkSession, root: str, identity: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written once under the digest of its identity and read from there on: a cache of features or of day sums."""
    folder = f"{root.rstrip('/')}/{hashlib.sha256(canonical(identity)).hexdigest()}"
    fs, done = _fs(spark, f"{folder}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def table_digest(df: DataFrame) -> dict:
    """(rows, digest) of a table, whatever the order of its rows: the sum of the rows' hashes, repeats counted."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h % (1 << 60)), F.lit(0).cast("decimal(38,0)")).alias("s")).first()
    return {"rows": r.n, "digest": format(int(r.s) % (1 << 64), "016x")}


#: The ledgers of a run.
LEDGERS = ("predictions", "availability", "credits", "exposures", "events")


def write_run(spark: SparkSession, path: str, ledgers: dict[str, DataFrame], facts: dict) -> dict:
    """A run's five ledgers as JSON lines and a manifest with their digests, published at once."""
    if sorted(ledgers) != sorted(LEDGERS):
        raise ValueError(f"a run has the ledgers {', '.join(LEDGERS)}")

    def write(folder: str) -> dict:
        for k, d in ledgers.items():
            d.write.option("ignoreNullFields", False).json(f"{folder}/{k}")
        m = {"ledgers": {k: table_digest(spark.read.schema(d.schema).json(f"{folder}/{k}")) for k, d in ledgers.items()}, "facts": facts}
        spark.createDataFrame([json.dumps(m, sort_keys=True)], "string").coalesce(1).write.text(f"{folder}/manifest")
        return m

    return published(spark, path, write)


def changed_ledgers(spark: SparkSession, path: str, ledgers: dict[str, DataFrame]) -> list[str]:
    """Names of ledgers that differ from those of the run at path: none where it was reproduced."""
    told = json.loads(spark.read.text(f"{path}/manifest").first()["value"])["ledgers"]
    return sorted(k for k in set(told) | set(ledgers) if k not in told or k not in ledgers or table_digest(ledgers[k]) != told[k])


def write_collection(path: str, tables: dict[str, dict], allowed: tuple[str, ...]) -> str:
    """A manifest of aggregate tables {name: {"rows", "digest"}}; names beyond the allowed ones are refused."""
    if extra := sorted(set(tables) - set(allowed)):
        raise IntegrityError("NOT_AGGREGATE", ", ".join(extra))
    return write_object(path, {"aggregate_only": True, "tables": tables})


def cells(df: DataFrame) -> DataFrame:
    """df with arrays joined by ';', as flat files want them."""
    return df.select(*[F.concat_ws(";", F.transform(F.col(c), lambda x: x.cast("string"))).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


#: Rows of a report's table; reports hold aggregates, not examples.
REPORT_ROWS = 10_000


def _rows(df: DataFrame | None) -> tuple[list[str], list[list]]:
    if df is None:
        return ["status"], [["not_available"]]
    got = cells(df).limit(REPORT_ROWS + 1).collect()
    if len(got) > REPORT_ROWS:
        raise ValueError("a report takes aggregates only")
    return (df.columns, [list(r) for r in got]) if got else (["status"], [["not_available"]])


def render(tables: dict[str, DataFrame | None], kind: str) -> str:
    """A report of aggregate tables as html, json or text."""
    data = {k: _rows(v) for k, v in tables.items()}
    if kind == "json":
        return json.dumps({k: [dict(zip(c, r)) for r in rows] for k, (c, rows) in data.items()}, indent=2, sort_keys=True, default=str)
    if kind == "text":
        return "\n".join(f"{k}\n" + "\n".join("\t".join(map(str, r)) for r in [c, *rows]) + "\n" for k, (c, rows) in data.items())
    if kind != "html":
        raise ValueError("html, json or text")
    row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in r) + "</tr>"
    body = "".join(f"<h2>{html.escape(k)}</h2><table>{row(c, 'th')}{''.join(row(r, 'td') for r in rows)}</table>" for k, (c, rows) in data.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>Report</title></head><body>{body}</body></html>'


def write_csv(df: DataFrame | None, path: str) -> None:
    import csv

    columns, rows = _rows(df)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(columns)
        w.writerows(rows)


#: The tables of a report.
TABLES = ("methods", "schedulers", "evaluations", "reliability", "slices", "paired-intervals", "paired-seeds", "intermediate-budget", "compute", "leakage-audit")


def write_tables(tables: dict[str, DataFrame | None], folder: str) -> list[dict]:
    """All tables of a report as CSV files in a folder of their own, with (path, bytes, sha256) of each."""
    if extra := sorted(set(tables) - set(TABLES)):
        raise ValueError(f"not tables of a report: {extra}")
    os.makedirs(folder, exist_ok=True)
    out = []
    for name in TABLES:
        write_csv(tables.get(name), os.path.join(folder, f"{name}.csv"))
        with open(os.path.join(folder, f"{name}.csv"), "rb") as f:
            data = f.read()
        out.append({"path": f"{name}.csv", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    return out
