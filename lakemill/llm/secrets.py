"""Secret scan with corpus-wide ownership frequency.

Base spans (assign, access, hex) come from fixed patterns. The method adds
high-recall candidates, which no pattern pins down: known token prefixes and
long random-looking tokens. Every candidate, base spans included, is hashed;
the corpus is aggregated to the number of distinct repositories (documents) and
distinct owners (sources) of each hash. A value looks live if at most
`live_owners` owners hold it, in at most `live_repos` repositories: what many
owners hold, or one owner holds all over, is a copied example. Added candidates
become spans only if they look live; base spans always stay, and each document
tells how many of its spans look live or widely copied.

Counting is in two steps, first by (hash, owner) and then by hash, both with
partial sums, so a value in a third of all documents costs a row per task.
Owners enter as ids, not as sets. Spans are rows of their own from the patterns
on, so that no step compares all spans of a document with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import stage
from lakemill.llm.spans import joined, meets_lower, spans, tagged

#: The base patterns. A run that a possessive quantifier takes
#: whole is the run that the plain pattern takes.
ASSIGN = r"""(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Prefixes of well-known token formats, then the bare token.
PREFIXED = r"(?=[gxsAe])(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{16,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{30,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"
RANDOM = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=.-])"
#: Of every kind but assign, a match holds a run like this.
LONG = r"[A-Za-z0-9+/_=.-]{20}"
LIVE_OWNERS = 2
LIVE_REPOS = 20


def _random_looking(p: Column) -> Column:
    """Lower and upper case, three digits or more, and many distinct signs."""
    n_digits = F.char_length(F.regexp_replace(p, "[^0-9]", ""))
    distinct = F.size(F.array_distinct(F.split(p, "")))
    return p.rlike("[a-z]") & p.rlike("[A-Z]") & (n_digits >= 3) & (distinct >= 14)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """For each row doc_id, n_assign, n_access, n_hex, base and spans (arrays
    of struct<start, rank, end, kind, match, value_hash, repos, owners, live>, sorted by start
    and kind), n_live and n_copied.

    Null text is empty; a null owner is an owner of its own. Rows with a null
    id are one document of each owner. Overlapping base kinds are all reported;
    an added candidate that overlaps a base one, or a random one that overlaps
    a prefixed one, is left to that. Texts of any length are scanned whole;
    time grows with their length and spans. Repeated rows are reported alike.
    Empty table: no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda p: F.regexp_extract(p, ASSIGN_VALUE, 1)
    assigned = tagged(spans(text, ASSIGN, keep=lambda p: F.char_length(value(p)) >= 6), 0, "assign")
    long = F.concat(
        tagged(spans(text, ACCESS, "AKIA"), 1, "access"),
        tagged(spans(text, HEX), 2, "hex"),
        tagged(spans(text, PREFIXED), 3, "prefixed"),
        tagged(spans(text, RANDOM, keep=_random_looking), 4, "random"),
    )
    kinds = F.when(text.rlike(LONG), F.concat(assigned, long)).otherwise(assigned)
    # The key hashes what is secret: the assigned value, or the whole match.
    own = lambda s: F.when(s["rank"] == 0, value(s["match"])).otherwise(s["match"])
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(owner_col), F.lit(0)).alias("owner"), kinds.alias("found"))
    found = found.withColumn("found", F.transform("found", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "match")], F.sha2(own(s), 256).alias("value_hash"))))
    found = stage(found, "candidates")  # the patterns run over the texts once
    each = found.where(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("s")).select("row", "doc_id", "owner", "s.*")
    # A candidate that meets a span of a kind that tells more is that span.
    rank = F.col("rank")
    each = each.withColumns({"in_base": meets_lower(rank < 3), "in_prefixed": meets_lower(rank == 3)})
    each = stage(each.where((rank < 3) | ~F.col("in_base") & ((rank == 3) | ~F.col("in_prefixed"))).drop("in_base", "in_prefixed"), "spans")
    by_owner = each.groupBy("value_hash", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    known = by_owner.groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    known = known.withColumn("live", (F.col("owners") <= live_owners) & (F.col("repos") <= live_repos))
    rich = each.join(known, "value_hash").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "match", "value_hash", "repos", "owners", "live"))).alias("found"))
    out = found.select("row", "doc_id").join(rich, "row", "left")
    out = out.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,match:string,value_hash:string,repos:bigint,owners:bigint,live:boolean>>)")))
    base = F.filter("found", lambda s: s["rank"] < 3)
    all_spans = F.filter("found", lambda s: (s["rank"] < 3) | s["live"])
    n = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), base.alias("base"), all_spans.alias("spans"),
        F.size(F.filter(all_spans, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def digest(spans_col: str) -> Column:
    return F.sha2(joined(F.col(spans_col)), 256)
