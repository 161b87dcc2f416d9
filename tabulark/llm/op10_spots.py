"""Document fingerprints: SpotSigs (DataFrame functions only).

A spot begins at an anchor, the last of a run of common words, and chains the
next two content words after it (common words between are passed over).  A
document's signature is the set of its spots; without a spot, the set of its
words.  Likeness is the Jaccard similarity of two signatures.  similar_pairs()
partitions signatures by their length and joins them on rare spots, so that
only pairs which can reach the threshold are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Common words of four languages: the anchors (fixed values).
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with you "
    "der die das den dem des ein eine und ist im nicht mit von zu auf für sich auch es "
    "le la les un une du de des et est que qui dans pour par sur pas au avec en ce "
    "el los las y se del al con para por su no lo como más o"
).split()
#: Rows of a range of ids that one window handles; ranges at most (their ends are in the plan: beyond ROWS x RANGES rows ranges
#: grow, and a window that does not fit in memory spills).
ROWS, RANGES = 128, 65536


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))


def with_spots(df: DataFrame, text: str, out: str, anchors=ANCHORS) -> DataFrame:
    """df with out: the sorted distinct spots of the text column, each as the
    first eight hex digits of an md5.  An empty text has none; null is empty."""
    w, p = f"_{out}_words", f"_{out}_content"
    got = df.withColumn(w, F.expr(rf"split(trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ')), ' ')"))
    got = got.withColumn(p, F.expr(f"filter(sequence(0, size({w}) - 1), i -> {w}[i] not in ({_listed(anchors)}))"))
    starts = f"filter(sequence(0, size({p}) - 2), j -> {p}[j] > if(j = 0, 0, {p}[j - 1] + 1))"
    spots = f"transform({starts}, j -> substr(md5(concat({w}[{p}[j] - 1], ' ', {w}[{p}[j]], ' ', {w}[{p}[j + 1]])), 1, 8))"
    got = got.withColumn(out, F.expr(f"if(size({p}) < 2, cast(array() as array<string>), array_sort(array_distinct({spots})))"))
    words = f"array_sort(array_distinct(transform(filter({w}, x -> x != ''), x -> substr(md5(x), 1, 8))))"
    return got.withColumn(out, F.expr(f"if(size({out}) = 0, {words}, {out})")).drop(w, p)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) with next_text and next_spots: those of the next row in
    descending doc_id (nulls last, ties by text); after the last comes the first.

    Ids are split into ranges of about `rows` rows; each range is one window, to
    which the first row of the following range is added.  Texts move once.
    """
    n, least, most = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(max(math.ceil(n / rows), 1), RANGES)
    cuts: list[int] = []
    if ranges > 1 and least is not None:
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 8 * ranges))).first()[0]) - {least})
    if cuts:
        step = math.isqrt(len(cuts)) + 1
        bounds, coarse = F.lit(cuts), F.lit(cuts[::step])
        skipped = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0)) * step
        place = F.coalesce(skipped + F.size(F.filter(F.slice(bounds, skipped + 1, step), lambda x: x <= F.col("doc_id"))), F.lit(0))
    else:
        place = F.lit(0)
    # the following range of a row's range is the next one down that has rows
    edges = [r for r in docs.select("doc_id", place.alias("place")).groupBy("place").agg(F.max("doc_id").alias("top")).orderBy(F.desc("place")).collect()]
    follow = {r.top: (edges[i - 1].place, i == 0) for i, r in enumerate(edges)}
    spread = docs.select("doc_id", "text", place.alias("place"), F.lit(0).alias("ghost"))
    if follow:
        spark = docs.sparkSession
        heads = spark.createDataFrame([(k, v[0]) for k, v in follow.items() if k is not None] or [(0, -1)], "head long, above int")
        # at most RANGES ids and numbers: a bounded broadcast
        copies = docs.join(F.broadcast(heads), docs["doc_id"] == heads["head"]).select("doc_id", "text", F.col("above").alias("place"), F.lit(1).alias("ghost"))
        nulls = [v[0] for k, v in follow.items() if k is None]
        if nulls:  # every id is null: one range
            copies = docs.where("doc_id is null").orderBy(F.col("text").asc_nulls_first()).limit(1).select("doc_id", "text", F.lit(nulls[0]).alias("place"), F.lit(1).alias("ghost"))
        spread = spread.unionByName(copies)
    dealt = with_spots(spread.repartition("place"), "text", "spots")
    order = Window.partitionBy("place").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return dealt.withColumns({"next_text": F.lead("text").over(order), "next_spots": F.lead("spots").over(order)}).where("ghost = 0").drop("place", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text, and its edit by the start of the next one.

    One row per row of docs(doc_id, text, ...): null texts count as empty,
    repeated rows stay, extra columns are ignored, an empty table gives none.
    fingerprint lists the spots, so equal texts have equal fingerprints.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = with_next(base)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    got = got.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    got = with_spots(got, "edited", "edited_spots")
    return got.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("spots", ",").alias("fingerprint"), F.array_join("edited_spots", ",").alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness), a < b, of classes whose signatures are at least threshold alike.

    Documents of equal signature are one class, named by its least doc_id;
    signature_classes() ties members to classes.  Rows without a doc_id have no
    class; null and empty texts have the empty signature, which is like no other;
    repeated rows are one; other columns are ignored; an empty table gives an
    empty result; a likeness of just the threshold counts.

    A pair can only reach the threshold if its shorter signature has threshold
    times the longer one's length, so signatures meet only in their own length
    partition and the next, and only on one of their rarest spots (a prefix of
    each sorted by frequency); only pairs whose shared spots' places leave the threshold open are compared.
    """
    reps = written(signature_classes(docs).where("doc_id = class_id and size(spots) > 0").groupBy("class_id").agg(F.first("spots").alias("spots")), "signatures")
    each = reps.select("class_id", F.explode("spots").alias("spot"))
    seen = each.groupBy("spot").agg(F.count("*").alias("df"))
    ranked = each.join(seen, "spot").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("by_df"))
    size = F.size("by_df")
    rare = ranked.select("class_id", size.alias("n"), F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9).cast("int").alias("part"), F.slice(F.col("by_df.spot"), 1, F.greatest(size - F.ceil(size * threshold - 1e-9).cast("int") + 1, F.lit(1))).alias("prefix"))
    rare = written(rare.select("class_id", "n", "part", F.posexplode("prefix").alias("at", "spot")), "prefixes")
    left = rare.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("at_a"), "part", "spot")
    right = rare.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "spot")
    shorter, longer = F.least("na", "nb"), F.greatest("na", "nb")
    # the places of a shared spot bound what the two can share: those before it, and from it on
    most = F.least("at_a", "at_b") + F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b"))
    can = left.join(right, ["part", "spot"]).where(F.col("a") != F.col("b")).where(shorter >= threshold * longer - 1e-9)
    can = can.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(most).alias("most"), F.first(F.col("na") + F.col("nb")).alias("both"))
    can = can.where(F.col("most") >= threshold / (1 + threshold) * F.col("both") - 1e-9).select("a", "b")
    both = can.join(reps.select(F.col("class_id").alias("a"), F.col("spots").alias("sa")), "a").join(reps.select(F.col("class_id").alias("b"), F.col("spots").alias("sb")), "b")
    return both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)


def signature_classes(docs: DataFrame) -> DataFrame:
    """Each document with spots and class_id, the least doc_id of equal signatures (null only if all are)."""
    got = with_spots(docs.select("doc_id", "text"), "text", "spots").select("doc_id", "spots", F.sha2(F.array_join("spots", ","), 256).alias("sig"))
    got = written(got, "spots")  # else filters on spots would be pushed below and repeat their expressions
    least = got.groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    return got.join(least, "sig").drop("sig")


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spots(text: str, name: str, source: str) -> str:
    listed = _listed(ANCHORS)
    return rf"""
{name}_w as (select *, string_split(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w from {source}),
{name}_c as (select *, list_filter(range(1, len(w) + 1), lambda i: w[i] not in ({listed})) as c from {name}_w),
{name}_s as (select *, list_transform(list_filter(range(1, len(c)), lambda j: c[j] > case when j = 1 then 1 else c[j - 1] + 1 end),
    lambda j: substr(md5(w[c[j] - 1] || ' ' || w[c[j]] || ' ' || w[c[j + 1]]), 1, 8)) as s from {name}_c),
{name} as (select * exclude (w, c, s), list_sort(list_distinct(case when len(s) > 0 then s
    else list_transform(list_filter(w, lambda x: x <> ''), lambda x: substr(md5(x), 1, 8)) end)) as {name}_spots from {name}_s)"""


SQL = rf"""
with base as (select doc_id, coalesce(text, '') as text from documents),
{_sql_spots("text", "own", "base")},
nexts as (select *, coalesce(lead(text) over o, first_value(text) over o) as next_text, coalesce(lead(own_spots) over o, first_value(own_spots) over o) as next_spots
    from own window o as (order by doc_id desc nulls last, text rows between unbounded preceding and unbounded following)),
edits as (select *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) as edited from nexts),
{_sql_spots("edited", "changed", "edits")},
met as (select *, len(list_intersect(own_spots, changed_spots)) as ie, len(list_intersect(own_spots, next_spots)) as inx from changed)
select doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, array_to_string(own_spots, ',') as fingerprint, array_to_string(changed_spots, ',') as edited_fingerprint,
  case when len(own_spots) = 0 and len(changed_spots) = 0 then 1e0 else ie::double / (len(own_spots) + len(changed_spots) - ie) end as near_edited,
  case when len(own_spots) = 0 and len(next_spots) = 0 then 1e0 else inx::double / (len(own_spots) + len(next_spots) - inx) end as near_next
from met
"""
