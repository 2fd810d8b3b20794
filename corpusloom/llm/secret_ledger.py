"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by its SHA-256.  The ledger holds a row for each (blob, rule
version) that was scanned, findings or not; a run scans only pairs it lacks, each blob once however
many documents hold it, and joins the findings back to all of them.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, documents, hashed_side, new_place, ship, staged

# The base kinds, in the order that breaks ties, and the shortest match that counts.
# Letters of the key words stand for either case, in ASCII alone.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]{24,}")
# Further kinds: private key headers, code forge tokens and web tokens.
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
WEB_CHAIN = re.compile(r"[A-Za-z0-9_.-]+")
WEB_SIGN, WEB_REST = "eyJ", 8
#: Raise this with every change of the rules: pairs of the older version no longer count as scanned.
RULE_VERSION = "1"

LEDGER_SCHEMA = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order, kind, end) of the base kinds, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    return found + [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]


def web_spans(text: str) -> list[tuple[int, int]]:
    """Web tokens, leftmost and non-overlapping: two parts that start with the sign and go on for at least so many characters, and a third.

    The first may start within a run of such characters.  Runs joined by dots are found first, so that the time is linear.
    """
    out = []
    for chain in WEB_CHAIN.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        starts = [at]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        i = 0
        while i + 2 < len(parts):
            sign = parts[i].find(WEB_SIGN)
            if 0 <= sign <= len(parts[i]) - len(WEB_SIGN) - WEB_REST and parts[i + 1].startswith(WEB_SIGN) and len(parts[i + 1]) >= len(WEB_SIGN) + WEB_REST and parts[i + 2]:
                out.append((starts[i] + sign, starts[i + 3] - 1))
                i += 3
            else:
                i += 1
    return out


def more_spans(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    for order, (kind, sign, rule) in enumerate((("pem", "-----BEGIN", PEM), ("forge", "gh", FORGE)), 3):
        if sign in text:
            out += [(m.start(), order, kind, m.end()) for m in rule.finditer(text)]
    return out + ([(start, 5, "web", end) for start, end in web_spans(text)] if WEB_SIGN in text else [])


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and spans of a text; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    kinds = [s[2] for s in base]
    sha = hashlib.sha256(joined(base).encode()).hexdigest()
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), sha, joined(base + more_spans(text))


def blob_address(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class BlobLedger:
    """The scanned (blob, rule version) pairs and their findings: Parquet files under ``path``, appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # An empty append makes the folder and its schema.
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)

    def findings(self, version: str) -> DataFrame:
        """One row a blob, also where runs at the same time have scanned it twice."""
        return self.recorded(version).dropDuplicates(["blob"])

    def recorded(self, version: str) -> DataFrame:
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path).filter(F.col("rule_version") == version)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def scan(docs: DataFrame, ledger: BlobLedger, version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs that the ledger lacks for ``version`` and returns the findings of every document.

    Reads doc_id and text.  Returns a row a document: doc_id, n_assign, n_access, n_hex, base_sha256 (of
    the base kinds' kind:start:end, comma-joined) and spans (all kinds' spans).  Offsets count code points.  A
    null text counts as empty.  Repeated rows and copies are scanned once and all reported.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = staged(docs.select("doc_id", blob_address(F.col("text")).alias("blob")), "ledger-blobs")
    # One document speaks for each blob; partial aggregation keeps hot blobs out of single tasks.
    chosen = rows.groupBy("blob").agg(F.min("doc_id").alias("_chosen"))
    unseen = staged(chosen.join(ledger.recorded(version).select("blob"), "blob", "left_anti").withColumnRenamed("blob", "_blob"), "ledger-unseen")
    n = unseen.count()
    if not n:
        return found_again(rows, ledger, version)
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_address(F.col("text")))
    # Only the texts of chosen documents survive; the side of keys is the one that is hashed.
    texts = held.join(hashed_side(unseen, n), held["doc_id"].eqNullSafe(unseen["_chosen"]) & (held["blob"] == unseen["_blob"]), "left_semi")

    def work(blobs, bodies):
        out = [scan_text(t) for t in bodies]
        return [blobs, [version] * len(blobs), *map(list, zip(*out, strict=True))]

    found = texts.select("blob", "text").mapInArrow(arrow_batches(work, LEDGER_SCHEMA), LEDGER_SCHEMA)
    ledger.append(found.dropDuplicates(["blob"]))
    return found_again(rows, ledger, version)


def found_again(rows: DataFrame, ledger: BlobLedger, version: str) -> DataFrame:
    """The ledger's findings of the blobs of ``rows`` (doc_id, blob), a row a row."""
    # Written, so that adaptive execution can split the rows of a hot blob: an aggregation in the join's stage would prevent it.
    known = staged(ledger.findings(version).drop("rule_version"), "ledger-known")
    return rows.join(known, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def query(spark, sf_dir):
    ledger = BlobLedger(spark, new_place(spark, "ledger"))
    return scan(documents(spark, sf_dir), ledger)
