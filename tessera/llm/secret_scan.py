"""Secret scan with corpus-wide ownership frequency.

Every text is searched for credential candidates. Candidate values are hashed, and each hash is aggregated over the
corpus by distinct repositories and distinct owners: a value that many owners carry is a copied example, a value that
one owner carries and that looks random is a live-looking credential. The value of a private key is its body.

Defined results: a null or empty text has no spans and the digest of the empty string; repeated rows are scanned each
for itself; a null repository counts as one more repository; a private key's header without a body is an
example; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Lists, carried, fields, kind, map_rows, materialize, named, others

# The kinds of the contract, in its order, then those that the ownership method adds.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
EXTRA = {
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "payment": re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}"),
    "cloud": re.compile(r"AIza[A-Za-z0-9_-]{30,}"),
    # Only at the start of a run of its letters, and without going back, so each run is read few times.
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    # The block to its END line, or if there is none before the next block, the header lines and base64 runs that follow.
    "pem": re.compile(
        r"""-----BEGIN\x20([A-Z\x20]{0,30})PRIVATE\x20KEY-----(?:(?P<whole>(?s:(?:(?!-----BEGIN\x20).)*?))-----END\x20\1PRIVATE\x20KEY-----
        |(?P<cut>(?:(?:\s|\\[nrt]|["',>\#*|;]|(?:\+|//)(?=\s))*+(?:[A-Z][A-Za-z-]{1,30}:\x20[^\n\\]*+|[A-Za-z0-9+/=]{16,}+))*+(?:(?:\s|\\[nrt]|["',>\#*|;])++[A-Za-z0-9+/=]{1,15}+(?=["'\\]|[\x20\t]*(?:[\r\n]|\Z)))?))""",
        re.X,
    ),
}
EXTRA_MARKS = ("gh", "xox", "k_live_", "AIza", "eyJ", "-----BEGIN ")
KEY_RUN = re.compile(r"[A-Za-z0-9+/]{16}")
PLACEHOLDER = re.compile(r"(?ai)example|sample|change_?me|placeholder|your|dummy|redacted|xxxx|1234567|abcdef")
KIND_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *EXTRA))}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of kind, end, value) of the contract's three kinds; the value, an assignment's right side, ends the span."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def extra_spans(text: str) -> list[tuple[int, int, int, str]]:
    if not any(x in text for x in EXTRA_MARKS):
        return []
    return sorted((m.start(), KIND_ORDER[k], m.end(), key_body(m) if k == "pem" else m[0]) for k, rx in EXTRA.items() for m in rx.finditer(text))


def key_body(found: re.Match) -> str:
    """A private key's characters, however its lines are broken, indented or quoted; empty where the text is no key's."""
    body = found["whole"] or found["cut"] or ""
    return re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", body) if KEY_RUN.search(body) else ""


def looks_live(value: str, key: bool = False) -> bool:
    """Random enough for a credential: no placeholder word, and at least 2.5 bits a character over 8 or more characters.

    A private ``key`` of over 64 characters may hold a short word by chance, so it is not searched for one."""
    if len(value) < 8 or not (key and len(value) > 64) and PLACEHOLDER.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 2.5


def _say(spans: list[tuple]) -> str:
    names = list(KIND_ORDER)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b, *_ in spans)


def _scan(rows: Lists) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "candidates")}
    for text in rows["_text"]:
        text = text or ""
        base = base_spans(text)
        kinds = Counter(k for _, k, *_ in base)
        for i, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(kinds[i])
        out["base_sha256"].append(hashlib.sha256(_say(base).encode()).hexdigest())
        out["candidates"].append([{"at": a, "kind": k, "till": b, "own": b - len(v) if k < len(BASE_KINDS) else a, "value": hashlib.sha256(v.encode()).digest()[:16], "live": looks_live(v, k == KIND_ORDER["pem"])} for a, k, b, v in base + extra_spans(text)])
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str | None, example_owners: int, carry: tuple[str, ...] = (), with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with counts and digest in the shared folder, candidates with their verdicts)."""
    owner = named(owner_col) if owner_col else F.substring_index(named(repo_col), "/", 1)
    extra, types = carried(docs, carry)
    read = docs.select(named(id_col).alias("_doc"), named(text_col).cast("string").alias("_text"), named(repo_col).cast("string").alias("_repo"), owner.cast("string").alias("_owner"), *extra).withColumn("_row", F.monotonically_increasing_id())
    scanned = map_rows(read, _scan, fields("_row long", ("_doc", kind(docs, id_col)), "_text string, _repo string, _owner string", *types, "n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<struct<at:int,kind:int,till:int,own:int,value:binary,live:boolean>>"))
    found = materialize(scanned if with_text else scanned.drop("_text"), "secrets")
    each = found.where(F.size("candidates") > 0).select("_row", "_repo", "_owner", F.explode("candidates").alias("c")).select("_row", "_repo", "_owner", "c.*")
    owners = (
        each.select("value", F.coalesce("_repo", F.lit("\0")).alias("_repo"), F.coalesce("_owner", F.lit("\0")).alias("_owner")).distinct()
        .groupBy("value").agg(F.countDistinct("_repo").alias("n_repos"), F.countDistinct("_owner").alias("n_owners"))
    )
    return found, each.join(owners, "value").withColumn("live", F.col("live") & (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_owners))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, example_owners: int = 3) -> DataFrame:
    """One row per document: doc_id, the counts and digest of the contract's kinds, ``spans`` with those that the method
    adds, and the verdicts: ``n_live`` candidates that look random and that fewer than ``example_owners`` owners carry,
    ``n_example`` others, ``live_spans`` the spans of the first. Without ``owner_col`` the part of the repository before
    a slash is its owner. A copied example of an added kind is no span; the contract's kinds always are.

    Plan: one scan whose digests are written to the shared folder; distinct (value, repository, owner) rows are made
    before they are shuffled, so a value that a third of the corpus copies costs a row per repository and task.
    """
    found, judged = _judged(docs, id_col, text_col, repo_col, owner_col, example_owners)
    span = F.struct("at", "kind", "till")
    by_row = judged.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < len(BASE_KINDS)) | F.col("live"), span))).alias("_all"),
        F.sort_array(F.collect_list(F.when(F.col("live"), span))).alias("_live"),
        F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.max("n_owners").alias("max_owners"),
    )
    names = F.array(*map(F.lit, KIND_ORDER))
    say = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["at"], s["till"])), ","), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return found.join(by_row, "_row", "left").select(
        F.col("_doc").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", say("_all").alias("spans"),
        zero("n_live"), zero("n_example"), zero("max_owners"), say("_live").alias("live_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, example_owners: int = 3, mask: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with the values of live-looking credentials masked; a column ``n_chars`` follows the text."""
    carry = others(docs, text_col)
    found, judged = _judged(docs, id_col, text_col, repo_col, owner_col, example_owners, carry, True)
    spans = judged.where("live").groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("own", "till"))).alias("_live"))

    def blank(rows: Lists) -> dict[str, list]:
        texts = []
        for text, live in zip(rows["_text"], rows["_live"]):
            out, at = [], 0
            for a, b in ((x["own"], x["till"]) for x in live or ()):
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            texts.append("".join(out) + text[at:] if live else text)
        return {"_text": texts}

    types = carried(docs, carry)[1]
    cols = ["_text", *[name for name, _ in types]]
    full = found.join(spans, "_row", "left")
    masked = map_rows(full.where(F.col("_live").isNotNull()).select(*cols, "_live"), blank, fields("_text string", *types))
    if "n_chars" in carry:
        name, kept_as = types[carry.index("n_chars")]
        masked = masked.withColumn(name, F.length("_text").cast(kept_as))
    own = dict(zip(carry, (F.col(name) for name, _ in types)))
    return full.where(F.col("_live").isNull()).select(*cols).union(masked).select(*[own.get(c, F.col("_text")).alias(c) for c in docs.columns])
