"""Secret scan with corpus-wide ownership frequency, in native expressions.

Candidates are cut out of each text by regular expressions. The digest of every candidate's
value is then counted over the whole corpus by distinct repositories and owners: a value that
several owners or many repositories hold is a copied example; one that few repositories of one
owner, or of an owner and a mirror, hold and that looks random is a live credential. Fixed-format kinds are always reported; the looser kinds are reported only
where the counts and the look of the value speak for a live credential.

In the tables at hand a document stands for a repository and its source for the owner.

Defined cases: a null or empty text has no spans; repeated rows are reported each and count as
one repository; a null owner or repository counts as one of its own; equal values at several
places give a span each; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_of, with_row_id


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value: int = 0  # the group that holds the secret itself
    least: int = 0  # shortest value that counts
    fixed: bool = True  # reported whatever the corpus says


# The formats looked for.
KINDS = (
    Kind(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=2,
        least=6,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Kind("forge", r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{30,}", fixed=False),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", fixed=False),
    Kind("chat", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}", fixed=False),
    Kind("pay", r"(?<![A-Za-z0-9_])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", fixed=False),
    Kind("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", fixed=False),
    Kind(
        "mixed",
        r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_-]{0,200}[0-9])(?=[A-Za-z0-9+/_-]{0,200}[A-Z])"
        r"(?=[A-Za-z0-9+/_-]{0,200}[a-z])[A-Za-z0-9+/_-]{24,200}={0,2}(?![A-Za-z0-9+/_-])",
        fixed=False,
    ),
)
COPIED_OWNERS = 3  # held by so many owners, a value is a copied example
COPIED_REPOSITORIES = 20  # held by so many repositories as well, whoever owns them
LIVE_BITS = 2.5  # entropy per character from which a value looks random
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Leftmost non-overlapping matches with their code-point positions.

    What lies between the matches gives their positions: lengths are summed up along the two
    lists that ``split`` and ``regexp_extract_all`` return.
    """
    pattern = F.lit(kind.pattern)
    pairs = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(kind.value)).alias("value"),
    )

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            pair["value"].alias("value"),
        )
        more = F.when(F.length(pair["value"]) >= kind.least, F.concat(state["out"], F.array(one)))
        return F.struct(end.alias("at"), F.coalesce(more, state["out"]).alias("out"))

    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    hits = F.filter(pairs, lambda p: p["hit"].isNotNull())  # the last gap has no match
    return F.when(text.rlike(kind.pattern), F.aggregate(hits, start, add)["out"]).otherwise(none)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    named = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    )
    return F.array_join(named, ",")


def entropy(value: Column) -> Column:
    """Shannon entropy of a short text in bits per character."""
    chars = F.split(value, "")
    size = F.size(chars).cast("double")
    shares = F.transform(
        F.array_distinct(chars),
        lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / size,
    )
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def find_candidates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source"
) -> DataFrame:
    """``_row, doc_id, repository, owner, fixed, loose`` of each row, without its text."""
    rows = with_row_id(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(repository).cast("string").alias("repository"),
            F.col(owner).cast("string").alias("owner"),
            text_of(text).alias("_text"),
        )
    )
    found = [(k, spans_of(F.col("_text"), k, i)) for i, k in enumerate(KINDS)]
    return rows.select(
        "_row",
        "doc_id",
        "repository",
        "owner",
        F.concat(*[s for k, s in found if k.fixed]).alias("fixed"),
        F.concat(*[s for k, s in found if not k.fixed]).alias("loose"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_repositories, n_owners`` of each candidate value of the corpus.

    Distinct triples come first, so a value in a third of all rows is spread by its holders.
    """
    held = found.select(
        "repository", "owner", F.explode(F.concat("fixed", "loose")).alias("_span")
    ).select("repository", "owner", F.sha2("_span.value", 256).alias("digest"))
    return (
        held.distinct()
        .groupBy("digest", "owner")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("digest")
        .agg(F.sum("_n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )


def judge_spans(
    found: DataFrame,
    copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES,
    live_bits: float = LIVE_BITS,
) -> DataFrame:
    """One row per span with the counts of its value and the verdict on it."""
    counts = cut_lineage(ownership(found))
    spans = found.select("_row", "doc_id", F.explode(F.concat("fixed", "loose")).alias("_span")).select(
        "_row", "doc_id", "_span", F.sha2("_span.value", 256).alias("digest")
    )
    bits = entropy(F.col("_span.value"))
    verdict = (
        F.when((F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories), "copied")
        .when(bits >= live_bits, "live")
        .otherwise("unclear")
    )
    return spans.join(counts, "digest").withColumn("verdict", verdict)


def scan_secrets(docs: DataFrame, **options) -> DataFrame:
    """Each row's spans: ``fixed`` ones, all reported ones, and how many are live or copied."""
    found = cut_lineage(find_candidates(docs, **options))
    fixed_kinds = [k.name for k in KINDS if k.fixed]
    covered = lambda s, f: (s["start"] < f["end"]) & (f["start"] < s["end"])
    own = F.filter(  # a loose span gives way to a fixed one and to a stricter loose one
        "loose",
        lambda s: ~F.exists("fixed", lambda f: covered(s, f))
        & ~F.exists("loose", lambda f: covered(s, f) & (f["rank"] < s["rank"])),
    )
    found = found.withColumn("loose", own)
    per_row = (
        judge_spans(found)
        .groupBy("_row")
        .agg(
            F.collect_list(
                F.when(
                    F.col("_span.kind").isin(fixed_kinds) | (F.col("verdict") == "live"), F.col("_span")
                )
            ).alias("spans"),
            F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
            F.count(F.when(F.col("verdict") == "copied", 1)).alias("n_copied"),
        )
    )
    none = F.array().cast(SPAN)
    return found.join(per_row, "_row", "left").select(
        "_row",
        "doc_id",
        "fixed",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
