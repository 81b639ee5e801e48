"""Secret scans over an incremental ledger of content-addressed blobs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .words import join_back, shared_folder, written

RULE_VERSION = "2"
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: kind, pattern, group whose length counts, least length, what a text must hold (a cheap first test)
RULES = [
    ("assign", _ASSIGN, 2, 6, _ASSIGN[:-3] + "{6,}))"),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, None),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, None),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, None),
]
#: Rules whose kinds the base counts and digests cover.
BASE = ("assign", "access", "hex")
#: A plain piece of text that each remaining rule needs.
NEEDLE = {"access": "AKIA", "github": "gh", "pem": "PRIVATE KEY-----", "jwt": "eyJ"}
#: A hot blob with more spans isn't broadcast.
MOST_HOT_SPANS = 1_000
SPAN_BLOCK = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int, first: str | None) -> Column:
    """Spans in code points of one rule's leftmost matches: what lies between them gives their places."""
    matches, counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("size"), F.transform(counted, lambda x: F.length(x)).alias("counted"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SPAN_BLOCK).cast("int")), lambda b: F.slice(steps, b * SPAN_BLOCK + 1, SPAN_BLOCK))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["size"], F.lit(0))))
    none = F.array().cast("array<int>")
    starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + F.coalesce(x["size"], F.lit(0))
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["counted"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def spans_in(block: Column) -> Column:
        return F.aggregate(block["steps"], F.struct(block["at"].alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])

    # block by block, so that a text of very many matches doesn't copy its whole list for each
    found = F.flatten(F.transform(F.arrays_zip(blocks.alias("steps"), starts.alias("at")), spans_in))
    test = text.contains(NEEDLE[kind]) & text.rlike(pattern) if kind in NEEDLE else text.rlike(first)
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def spans_of(text: Column) -> Column:
    """All rules' spans, by start, then rule."""
    return F.array_sort(F.concat(*[_spans(text, i, *rule) for i, rule in enumerate(RULES)]))


def scan_versions(versions: DataFrame, ledger: str | None = None, *, rule_version: str = RULE_VERSION) -> DataFrame:
    """``versions`` without their text, with blob_id and spans joined from the ledger.

    A blob is one distinct text (null counts as empty), named by its SHA-256. Only blobs that the
    ledger (a Parquet folder of blob_id, rule_version, spans) doesn't hold under this rule version
    are scanned; they are appended to it. With no ledger given a new one is made in the shared folder.
    Rows repeat as given, null ids too; ties have one answer, as equal texts share their findings. Columns named
    blob_id or spans are replaced. An empty table gives no rows and adds nothing to the ledger; texts of any length are scanned whole.
    """
    spark = versions.sparkSession
    path = ledger or shared_folder(spark, "secret-ledger")
    schema = f"blob_id string, rule_version string, spans {SPAN}"
    if ledger is None or not _exists(versions, path):
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    body = F.coalesce("text", F.lit(""))
    texts = versions.select(row.alias("_row"), F.sha2(body, 256).alias("blob_id"), body.alias("_text"))
    seen = spark.read.schema(schema).parquet(path).where(F.col("rule_version") == rule_version)
    unseen = texts.groupBy("blob_id").agg(F.min("_row").alias("_row")).join(seen.select("blob_id"), "blob_id", "left_anti")
    # one row for each unseen blob; the list is the hashed side, so texts move once and are never sorted
    fresh = texts.join(unseen.hint("shuffle_hash"), ["_row", "blob_id"], "left_semi").select("blob_id", F.lit(rule_version).alias("rule_version"), spans_of(F.col("_text")).alias("spans"))
    fresh.write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path).where(F.col("rule_version") == rule_version)
    found = found.groupBy("blob_id").agg(F.first("spans").alias("spans"))  # repeated rows may have been scanned twice
    paths = versions.drop("blob_id", "spans").withColumn("blob_id", F.sha2(body, 256)).drop("text")
    # a blob may be a third of all versions
    counts = paths.groupBy("blob_id").agg(F.count("*").alias("n"))
    return join_back(paths, written(counts.join(found, "blob_id"), "secret-blobs"), "blob_id", narrow=F.size("spans") <= MOST_HOT_SPANS, blanks=False)


def _exists(frame: DataFrame, path: str) -> bool:
    jvm = frame.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).exists(folder)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of scanned versions."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; n_chars follows the new text, the rest stays.

    Null and empty texts stay as they are; repeated rows repeat; overlapping spans become one mark; a table without rows gives none.
    """
    scanned = scan_versions(docs.select("doc_id", "text"))
    found = scanned.where(F.size("spans") > 0).groupBy(F.col("blob_id").alias("_blob")).agg(F.first("spans").alias("_spans"), F.count("*").alias("n"))
    found = written(found, "secrets-found")
    rows = join_back(docs.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")), 256)), found, "_blob", narrow=F.size("_spans") <= MOST_HOT_SPANS, blanks=False)
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:  # overlapping spans make one mark
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))).alias("out")))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    rows = rows.withColumn("_new", new)
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("_new").cast("long"))
    return rows.select(*[v.alias(k) for k, v in columns.items()])
