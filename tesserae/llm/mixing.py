"""Mixing sources to target weights: Efraimidis-Spirakis sampling without Python on the data path.

Each document draws the key -ln(u) / weight, u a hash of its id in (0, 1]. In key order within its
source, documents are a weighted sample without replacement, however many are taken. A source whose
target is e whole times its size plus a rest takes e complete epochs and then the documents whose
running total in key order is within the rest (the one that straddles it goes to the nearer side).

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id draws
the key of the empty id. Repeated rows draw equal keys and are taken one after the other. Documents
of size 0 take nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import discard, materialise, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def words(text: Column) -> Column:
    """How many words a text has; the text itself is not cut up."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1 that falls with the share of symbols and digits among the characters."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, "#*$%&|<>{}[]=_~^\\0123456789", ""))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * junk.cast("double") / n)), F.lit(1.0))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """sources(source, source_size, ...) -> the same with target.

    The fixed point of sharing by weight and resharing the excess over a cap is min(cap, level *
    weight). In the order of cap / weight, a prefix of the sources is capped; one pass over the
    table of sources (a row for each, never the documents) finds the level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    s = s.withColumn("_cap", (F.col("source_size") * most_epochs).cast("double"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, after, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_).cast("double")
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    s = s.withColumn("_open", F.col("_cap") >= F.col("_level") * F.col("_w"))
    s = s.withColumn("_cut", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")).alias("x"))).over(all_))
    level = F.col("_cut").getField(s.schema["_cut"].dataType.names[1])
    return s.withColumn("target", F.when(F.col("_cut").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))).drop("_w", "_cap", "_level", "_open", "_cut")


def drawn(docs: DataFrame, seed: str, quality_of) -> dict[str, Column]:
    """What a document draws: its size, its weight and its place in the order of its source, from its own columns alone."""
    text = F.col("text")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    weight = quality_of(text)
    key = -F.log((u + 1.0) / F.lit(4503599627370496.0)) / weight
    return {"size": words(text), "_weight": weight, "_key": key, "_hash": F.xxhash64("doc_id")}


def chosen(docs: DataFrame, weights: tuple, most_epochs: int, seed: str, quality_of) -> DataFrame:
    """doc_id, source, size, source_size, target, _key, _hash, _epochs, _more (whether the fraction takes it) for each row."""
    draw = drawn(docs, seed, quality_of)
    rows = docs.select("doc_id", "source", *[c.alias(n) for n, c in draw.items()])
    rows = materialise(rows, "mix_rows")  # texts are read once; the steps below need these few columns
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.avg("_weight").alias("_mean"))
    sources = targets(sources, weights, most_epochs)
    sources = sources.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_source")
    known = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    count = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("_n"))))
    known = known.withColumn("_bucket", F.least(count - 1, F.floor((1.0 - F.exp(-F.col("_key") * F.col("_mean"))) * count)).cast("long"))
    known = running_total(known, ["source"], "_bucket", ["_key", "_hash", "doc_id", "size"], F.col("size"), "_before")
    more = F.col("_before") + F.col("size") / 2.0 <= F.col("_rest")
    return known.select("doc_id", "source", "size", "source_size", "target", "_key", "_hash", "_epochs", more.alias("_more"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix", quality_of=quality) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs(doc_id, text, source)."""
    known = chosen(docs, weights, most_epochs, seed, quality_of)
    taken = (F.col("_epochs") + F.when(F.col("_more"), 1).otherwise(0)) * F.col("size")
    return known.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix", quality_of=quality) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it; rows of size 0 stay once.

    The fraction takes a beginning of its source's order: once a document is left, all after it are.
    So a row for each source, with the last place taken, decides for each document by itself, and texts
    are not shuffled. Of equal rows at that last place only some may be taken: those alone are numbered.
    """
    place = ["_key", "_hash", "doc_id", "size"]
    known = materialise(chosen(docs, weights, most_epochs, seed, quality_of).where("size > 0").select("source", F.struct(*place).alias("at"), "_epochs", "_more"), "mix_places")
    edges = known.groupBy("source").agg(F.max(F.when(F.col("_more"), F.col("at"))).alias("edge"), F.first("_epochs").alias("_epochs")).withColumnRenamed("source", "_s")
    at_edge = known.join(edges.drop("_epochs"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("edge")))
    split = at_edge.groupBy("source").agg(F.count_if("_more").alias("_some"), F.count(F.lit(1)).alias("_all")).withColumnRenamed("source", "_t")
    edges = materialise(edges.join(split, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"), "mix_edges", split=F.count_if(F.col("_some") < F.col("_all")))
    discard(known)
    names = docs.columns
    draw = drawn(docs, seed, quality_of)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("source").alias("_source"), *[draw[n].alias(f"_draw_{n}") for n in ("_key", "_hash", "size")], F.col("doc_id").alias("_draw_doc_id"))
    rows = rows.join(edges, F.col("_source").eqNullSafe(F.col("_s")), "left")
    mine = F.struct(*[F.col(f"_draw_{n}").alias(n) for n in place])
    within = F.coalesce(mine < F.col("edge"), F.lit(False))
    last = F.coalesce(mine == F.col("edge"), F.lit(False))
    once = F.when(F.col("_draw_size") > 0, F.col("_epochs") + F.when(within, 1).otherwise(0)).otherwise(1).cast("int")
    whole = once + F.when(last & (F.col("_draw_size") > 0) & (F.col("_some") == F.col("_all")), 1).otherwise(0)
    out = rows.withColumn("_copies", whole)
    if edges.seen["split"]:
        some = last & (F.col("_draw_size") > 0) & (F.col("_some") < F.col("_all"))
        number = out.where(some).withColumn("_b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.lit(1), F.floor(F.sqrt("_all"))).cast("long")))
        number = running_total(number, ["_source"], "_b", ["_draw__hash"], F.lit(1), "_nth")
        number = number.withColumn("_copies", F.col("_copies") + F.when(F.col("_nth") < F.col("_some"), 1).otherwise(0)).drop("_b", "_nth")
        out = out.where(~some).unionByName(number)
    out = out.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return out.select("_row.*")
