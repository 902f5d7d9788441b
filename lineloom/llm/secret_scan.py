"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text: those of known shapes, and generic ones, long tokens that look random and have no shape to go by.
Each candidate value is hashed, and the hashes are counted over distinct owners (the source column) and distinct documents of the whole
table. A value that many owners hold is a copied example; one that a single owner or few hold, and that looks random, is live.
A generic candidate is a span only if it is live: its ownership alone tells a credential from a digest or an identifier that goes round. The
value of a private key is its body, however its lines are broken; a BEGIN line without a body has an empty value, and is weak.

Defined results: null or empty text has no spans (the digest is that of the empty string), and an empty table gives no rows. A null source is
an owner of its own. Each row counts by itself; equal rows get equal results. Spans that tie on their start stand in the order of the kinds. Very
long texts are searched as a whole. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.rows import per_batch
from lineloom.storage import materialize

#: Owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 5
MIN_ENTROPY = 2.5

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What stands between the lines of a key: line ends, written out too, indents, quotes and comment marks.
BETWEEN = r"""(?:\\[nrt]|[\s"'>#*|,\\])"""
#: A private key through its END line; where that is missing, through the end of its base64 body. The group is the body.
PEM = (
    r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----(?:((?:(?!-----)[\s\S])*+)-----END \1-----|"
    rf"((?:{BETWEEN}++(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{BETWEEN}++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:(?<=[A-Za-z0-9+/=]{{16}}){BETWEEN}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[\"',\x20\t\r]*+(?:\n|\\n|\Z)))?))"
)
APART = re.compile(BETWEEN)
#: Kinds beyond the base ones: (kind, a string that must stand in the text (for bearer in any case), pattern).
MORE = [
    ("bearer", "earer ", re.compile(r"(?ai:bearer)\x20+([A-Za-z0-9._~+/-]{20,}=*)")),
    ("github", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", "PRIVATE KEY", re.compile(PEM)),
    ("slack", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
]
#: Tokens that may be generic candidates: of mixed case and with digits, and of so many bits a character.
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
GENERIC_ENTROPY = 3.5
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, *(m[0] for m in MORE), "generic"))}


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of every candidate, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    lowered = text.lower()
    for kind, mark, pattern in MORE:
        if mark in (lowered if kind == "bearer" else text):
            out += [(m.start(), m.end(), kind, APART.sub("", m[m.lastindex]) if kind == "pem" else m[m.lastindex or 0]) for m in pattern.finditer(text)]
    loose = [m for m in GENERIC.finditer(text) if _mixed(m[0]) and entropy(m[0]) >= GENERIC_ENTROPY]
    if loose:
        taken = sorted((a, b) for a, b, *_ in out)
        ends = list(itertools.accumulate((b for _, b in taken), max))
        for m in loose:  # what a known shape holds or touches isn't told twice
            k = bisect.bisect_left(taken, (m.end(),))
            if not k or ends[k - 1] <= m.start():
                out.append((m.start(), m.end(), "generic", m[0]))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def _mixed(token: str) -> bool:
    return token != token.lower() and token != token.upper()


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found)


SPAN = "struct<start:long,place:int,end:long,kind:string,value_hash:string,entropy:double>"
FOUND = pa.struct([("start", pa.int64()), ("place", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("value_hash", pa.string()), ("entropy", pa.float64())])


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, owner, base counts and digest, and found: the candidates."""

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {k: [] for k in BASE}
        shas, found = [], []
        for text in b.column(2).to_pylist():
            f = find(text) if text else []
            base = [x for x in f if x[2] in BASE]
            for k in BASE:
                counts[k].append(sum(x[2] == k for x in base))
            shas.append(hashlib.sha256(_join(base).encode()).hexdigest())
            found.append([{"start": a, "place": ORDER[k], "end": e, "kind": k, "value_hash": hashlib.sha256(v.encode()).hexdigest(), "entropy": entropy(v)} for a, e, k, v in f])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(shas), pa.array(found, pa.list_(FOUND))],
            names=["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )

    has_source = "source" in docs.columns
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("source") if has_source else F.lit(None)).cast("string").alias("owner"), F.col("text").cast("string").alias("text"))
    return per_batch(picked, make, f"doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """Of each value_hash: n_owners, n_docs. Two steps, each with a map-side part, so no value gathers its rows in one task."""
    owned = found.groupBy("value_hash", F.coalesce("owner", F.lit("\0")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    return owned.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_docs"))


def scan_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """One row per document, with judged: its candidates with n_owners, n_docs and verdict (live, example or weak)."""
    held = materialize(candidates(docs).withColumn("row_no", F.monotonically_increasing_id()), "secrets")
    each = held.filter(F.size("found") > 0).select("row_no", "owner", F.explode("found").alias("f")).select("row_no", "owner", "f.*")
    once = each.select("row_no", "owner", "value_hash").distinct()
    counts = materialize(ownership(once), "secret-owners")
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("entropy") < min_entropy, "weak").otherwise("live")
    judged = each.join(counts, "value_hash").withColumn("verdict", verdict)
    per_doc = judged.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind", "value_hash", "n_owners", "n_docs", "verdict"))).alias("judged"))
    none = F.array().cast(per_doc.schema["judged"].dataType)
    out = held.join(per_doc, "row_no", "left").withColumn("judged", F.coalesce("judged", none))
    # a generic candidate is a span only by its ownership
    told = F.filter("judged", lambda x: (x["kind"] != "generic") | (x["verdict"] == "live"))
    spans = F.array_join(F.transform(told, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    live = F.size(F.filter("judged", lambda x: x["verdict"] == "live")).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), live.alias("n_live"), (F.size(told) - live).cast("long").alias("n_other"), "judged")
