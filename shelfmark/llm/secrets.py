"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Three base kinds are found in the whole text: `assign` (a keyword, a sign, a value of 6 or more
characters), `access` (AKIA identifiers of 20 or more) and `hex` (runs of 24 or more). `loose`
candidates are long tokens of letters and digits that no base span covers. The hash of every
candidate value is counted over the corpus by distinct repositories and distinct owners, and every
span carries both counts. A value of `copied_owners` or more owners, or in `copied_repos` or more
repositories whoever owns them, is a copied example; a value of one owner in fewer looks live; others
are shared. A repository belongs to its owner: equal names under two owners are two. Base spans stay
whatever their class; a loose candidate becomes a span only if it looks live, for a widely copied
long token is no secret.

Offsets are code points, end exclusive. They come from native functions alone: the pieces between
matches (`split`) and the matches (`regexp_extract_all`) alternate, so running sums of their lengths
are the positions. The sums, and what covers a loose candidate, are windows over the matches of a
text, in time that grows with their number.

Edge cases: a null text is empty and has no spans; very long texts are scanned whole; a null owner
or repository counts as ''; repeated rows are scanned each and count as one owner and repository; an
empty table gives an empty result; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import join_hot, materialise

KINDS = ("assign", "access", "hex", "loose")

ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A run that is too short fails as a whole, so the length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LOOSE = "[A-Za-z0-9+/_=-]{24,}"
MIN_ASSIGN = 6


def matches(text: Column, kind: int, pattern: str, value_group: int, fits: Callable[[Column], Column]) -> Column:
    """array<struct<kind, i, gap, n, hash>> of the leftmost non-overlapping matches of `pattern`.

    gap: characters since the match before; n: characters of the match; hash: of its value, null if
    the value does not fit. Positions need all matches, so those that do not fit are kept here.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all")
    )
    value = lambda x: F.regexp_extract(x, pattern, value_group) if value_group else x
    found = F.transform(
        F.filter(pieces, lambda x: x["all"].isNotNull()),  # the last gap has no match after it
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["all"]).alias("n"),
            F.when(fits(value(x["all"])), F.sha2(value(x["all"]), 256)).alias("hash"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,hash:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, owner, repo and the matches of all kinds; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    always = lambda v: F.lit(True)
    return docs.select(
        "doc_id",
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])).alias("repo"),
        F.concat(
            matches(text, 0, ASSIGN, 2, lambda v: F.length(v) >= MIN_ASSIGN),
            matches(text, 1, ACCESS, 0, always),
            matches(text, 2, HEX, 0, always),
            matches(text, 3, LOOSE, 0, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
        ).alias("found"),
    )


def candidates(pinned: DataFrame) -> DataFrame:
    """row, owner, repo, kind, s, e, hash: base spans, and loose ones that no base span covers."""
    found = pinned.select("row", "owner", "repo", F.explode("found").alias("m")).select("row", "owner", "repo", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        found.repartition("row")
        .withColumn("e", F.sum(F.col("gap") + F.col("n")).over(upto))
        .filter(F.col("hash").isNotNull())
        .select("row", "owner", "repo", "kind", (F.col("e") - F.col("n")).alias("s"), "e", "hash")
    )
    base = F.col("kind") < 3
    running = (Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("row").orderBy("s", "kind").rowsBetween(*running)
    after = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("kind")).rowsBetween(*running)
    reach, start = F.max(F.when(base, F.col("e"))).over(before), F.min(F.when(base, F.col("s"))).over(after)
    covered = placed.withColumns({"reach": reach, "start": start})
    free = F.coalesce(F.col("reach") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("start") >= F.col("e"), F.lit(True))
    return covered.filter(base | free).drop("reach", "start")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos, times: distinct owners and repositories of each value, and its candidates.

    The first aggregate reduces every (hash, owner, repo) to one row before and in its shuffle, so
    a value copied everywhere costs as many rows as it has repositories.
    """
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("times"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("times").alias("times"))
    sums = [F.sum(c).alias(c) for c in ("repos", "times")]
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), *sums)


def find_secrets(
    docs: DataFrame,
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    copied_owners: int = 3,
    copied_repos: int = 4,
) -> DataFrame:
    """Per row of `docs`: doc_id and spans, an array of structs, by start and kind.

    A span has s, order, e, kind, hash and class, and the distinct owners and repos of its value in the corpus.
    """
    pinned = scan(docs, owner_col, repo_cols).withColumn("row", F.monotonically_increasing_id())
    pinned = materialise(pinned, "secret-matches")
    found = materialise(candidates(pinned), "secret-candidates", few=True)
    owned = materialise(ownership(found), "secret-owners", few=True)
    kinds = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    example = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    classed = (
        join_hot(found, owned, "hash", "times", "row")
        .withColumn("class", F.when(example, "example").when(F.col("owners") == 1, "live").otherwise("shared"))
        .filter((F.col("kind") < 3) | (F.col("class") == "live"))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("s", F.col("kind").alias("order"), "e", kinds.alias("kind"), "hash", "class", "owners", "repos")
                )
            ).alias("spans")
        )
    )
    none = F.array().cast(classed.schema["spans"].dataType)
    return pinned.select("row", "doc_id").join(classed, "row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(
        ",",
        F.transform(
            spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
        ),
    )
