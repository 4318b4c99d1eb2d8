"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight; it stops at `most` times the source's words, and what is above is
shared again by weight among the others. Each document of a source is to be taken f = target / source size times: the
whole part of f always, one time more with probability p, the fraction. The fractions are rounded together: two documents are
paired and words move from one to the other, in a random direction that keeps both expectations, until one of the two
probabilities is 0 or 1; the other goes on to the next pair. So the words taken stay what they were, but for the last
document of each source, which is drawn by its probability. What that draw adds to or takes from the source is then made good
by turning the decisions of a bounded number of other documents of all sizes, each only if that brings the source nearer to its target.

Pairing is a tree: a chunk of about FAN documents is folded into its decisions and one open document, FAN chunks' open
documents are folded in turn, and so on until one is left per source. Chunks and draws come from hashes, so reruns and
retried tasks agree. All of it is DataFrame functions.

Edge cases: a null or empty text has size 0, moves no words and is drawn by itself; a null source is a source, the last in
order; rows with equal id, source and size share one decision; null ids take part; an empty table gives an empty result;
extra columns are kept by taken_rows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.llm import shared
from tapeforms.llm.quality import let

MOST = 3
WEIGHTS = (1, 2, 3)
FAN = 256
SEED = 5
CLOSE = 1e-9
#: Parts of a class of sizes, of which each offers a document that may be turned.
DEALT = 16


def words(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), shared.SPACE_PATTERN), lambda w: w != "")).cast("long")


def uniform(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row per source, so that windows over all of them stay small.

    Sorted by the level at which a source is full, the water level is the first at which no source below is short.
    """
    ranked = sources.withColumn("_r", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_r") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_full", "_r")
    everything = F.sum("source_size").over(W.partitionBy())
    full_before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    leveled = weighed.withColumn("_level", (everything - full_before) / weight_from)
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_r", "_level"))).over(W.partitionBy())["_level"]
    return leveled.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap").cast("double")))).select("source", "source_size", "target")


def paired(one: Column, two: Column, seed: int) -> Column:
    """What a pair comes to: struct(decided: array of (item, up), rest: item or null)."""
    up, down = F.least((1 - one["p"]) * one["a"], two["p"] * two["a"]), F.least(one["p"] * one["a"], (1 - two["p"]) * two["a"])

    def moved(m: Column) -> Column:
        gains = m["gains"]
        first = F.when(gains, F.when(m["up"] >= (1 - one["p"]) * one["a"], 1.0).otherwise(one["p"] + m["up"] / one["a"])).otherwise(F.when(m["down"] >= one["p"] * one["a"], 0.0).otherwise(one["p"] - m["down"] / one["a"]))
        second = F.when(gains, F.when(m["up"] >= two["p"] * two["a"], 0.0).otherwise(two["p"] - m["up"] / two["a"])).otherwise(F.when(m["down"] >= (1 - two["p"]) * two["a"], 1.0).otherwise(two["p"] + m["down"] / two["a"]))
        return let(F.array(one.withField("p", first), two.withField("p", second)), lambda both: F.struct(F.filter(both, settled).alias("decided"), F.get(F.filter(both, lambda x: ~settled(x)), F.lit(0)).alias("rest")))

    draw = uniform(F.lit(seed), one["h"], two["h"])
    return let(F.struct(up.alias("up"), down.alias("down"), (draw * (up + down) < down).alias("gains")), moved)


def settled(item: Column) -> Column:
    return (item["p"] < CLOSE) | (item["p"] > 1 - CLOSE)


def folded(items: DataFrame, seed: int) -> DataFrame:
    """(sid, chunk, decided, rest) from items (sid, chunk, it): each chunk's documents paired one after another.

    The order is by falling size: an open document then meets documents of about its size first, which may settle it. Where there are few of these, a large
    one stays open to the end; see made_good().
    """
    held = items.groupBy("sid", "chunk").agg(F.sort_array(F.collect_list("it")).alias("its"))
    kind = items.schema["it"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("decided"), F.lit(None).cast(kind).alias("rest"))

    def step(state: Column, item: Column) -> Column:
        alone = F.struct(F.when(settled(item), F.concat(state["decided"], F.array(item))).otherwise(state["decided"]).alias("decided"), F.when(settled(item), state["rest"]).otherwise(item).alias("rest"))
        met = let(paired(state["rest"], item, seed), lambda r: F.struct(F.concat(state["decided"], r["decided"]).alias("decided"), r["rest"].alias("rest")))
        return F.when(state["rest"].isNull() | settled(item), alone).otherwise(met)

    return held.select("sid", "chunk", F.aggregate("its", start, step).alias("f")).select("sid", "chunk", "f.decided", "f.rest")


def keyed(docs: DataFrame, id_col: str, source: str, seed: int) -> DataFrame:
    """docs with _h and _g, hashes of id, source and size that stand for a document."""
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(source).isNull(), F.col(source), F.col("_size")]
    return docs.withColumns({"_h": F.xxhash64(F.lit(seed), *parts), "_g": F.xxhash64(*reversed(parts))})


def decisions(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """(_h, _g, id, m, size, source_size, target, copies) for the m rows of docs with equal id, source and size."""
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words(text).alias("_size")), "id", "source", seed)
    items = shared.cut(rows.groupBy("_h", "_g").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("_size").alias("size"), F.count(F.lit(1)).alias("m")))
    # Sources are few next to documents; sid replaces the name, so that null is one like any other.
    sums = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    aimed = targets(sums.select("source", "source_size"), weights, most)
    sid = F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name"))
    per = shared.cut(aimed.withColumn("sid", sid).join(sums.select(sid.alias("sid"), "n"), "sid").select("sid", "source_size", "target", "n"))
    share = F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per = per.withColumn("_f", share).withColumn("whole", F.floor(F.col("_f") + CLOSE)).withColumn("p", F.greatest(F.lit(0.0), F.col("_f") - F.col("whole"))).drop("_f")
    placed = shared.sized_join(items.withColumn("sid", sid), per, ["sid"], "inner")
    item = F.struct((-F.col("size") * F.col("m")).alias("k"), F.col("_h").alias("h"), F.col("_g").alias("g"), F.col("id"), F.col("size"), F.col("m"), (F.col("size") * F.col("m")).cast("double").alias("a"), F.col("p"))
    chunk = F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.ceil(F.col("n") / fan)).alias("chunk")
    live = placed.where("size > 0").select("sid", chunk, item.alias("it"))
    alone = placed.where("size = 0").select("sid", item.withField("p", F.when(uniform(F.lit(seed + 2), "_h") < F.col("p"), 1.0).otherwise(0.0)).alias("it"))
    decided = [alone]
    width = per.agg(F.max(F.ceil(F.col("n") / fan))).first()[0] or 1
    while True:
        level = shared.cut(folded(live, seed))
        decided.append(level.select("sid", F.explode("decided").alias("it")))
        rest = level.where("rest is not null").select("sid", "chunk", F.col("rest").alias("it"))
        if width == 1:
            break
        width = -(-width // fan)
        live = rest.withColumn("chunk", F.floor(F.col("chunk") / fan))
    last = shared.cut(rest.select("sid", "it", (uniform(F.lit(seed + 3), F.col("it.h")) < F.col("it.p")).alias("up")))
    decided.append(last.select("sid", F.col("it").withField("p", F.when(F.col("up"), 1.0).otherwise(0.0)).alias("it")))
    together = decided[0]
    for more in decided[1:]:
        together = together.unionByName(more)
    together = shared.cut(together)
    turned = shared.cut(made_good(together, last))
    ends = shared.sized_join(together.withColumns({"h": F.col("it.h"), "g": F.col("it.g")}), turned, ["sid", "h", "g"], "left")
    up = F.coalesce(F.col("to"), F.round(F.col("it.p")))
    copies = (F.col("whole") + up).cast("int")
    return shared.sized_join(ends, per.drop("p", "n"), ["sid"], "inner").select(F.col("it.h").alias("_h"), F.col("it.g").alias("_g"), "it.id", "it.m", "it.size", "source_size", "target", copies.alias("copies"))


def made_good(decided: DataFrame, last: DataFrame) -> DataFrame:
    """(sid, h, g, to): decisions to turn, so that the words that the draw of each source's last document (sid, it, up) added or took are few in the end.

    In each class of sizes between powers of two, DEALT taken and as many untaken documents can be turned, each the smallest of its part. From the largest down, each is that brings the source nearer to
    its target, so what is off only gets less.
    """
    off = F.when(F.col("up"), (1 - F.col("it.p")) * F.col("it.a")).otherwise(-F.col("it.p") * F.col("it.a"))
    open_ = shared.cut(last.select("sid", off.alias("off"), F.col("it.h").alias("last")))
    up = F.col("it.p") > 0.5
    free = shared.sized_join(decided.where("it.a > 0").select("sid", up.alias("up"), "it"), open_, ["sid"], "inner").where("it.h <> last and it.a < 2 * abs(off)")
    least = free.groupBy("sid", "up", F.floor(F.log2("it.a")).alias("class"), F.pmod("it.h", F.lit(DEALT)).alias("part")).agg(F.min(F.struct("it.a", "it.h", "it.g")).alias("x"))
    lists = least.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("x.a", "up", "x.h", "x.g")), asc=False).alias("xs")).join(open_, "sid")
    kind = "struct<a:double,up:boolean,h:bigint,g:bigint>"

    def step(state: Column, x: Column) -> Column:
        then = state["off"] + F.when(x["up"], -x["a"]).otherwise(x["a"])
        return F.when(F.abs(then) < F.abs(state["off"]), F.struct(then.alias("off"), F.concat(state["out"], F.array(x)).alias("out"))).otherwise(state)

    turned = lists.select("sid", F.explode(F.aggregate("xs", F.struct(F.col("off"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda s: s["out"])).alias("x"))
    return turned.select("sid", "x.h", "x.g", F.when(F.col("x.up"), 0.0).otherwise(1.0).alias("to"))


def taken(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row of docs; taken is in words, repeats counted."""
    out = decisions(docs, id_col, **how).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def taken_rows(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    chosen = shared.cut(decisions(docs, id_col, source, text, seed=seed, **how).where("copies > 0").select("_h", "_g", "copies"))
    rows = shared.packed(docs).select("_row", F.col(f"_row.{id_col}").alias("id"), F.col(f"_row.{source}").alias("source"), words(f"_row.{text}").alias("_size"))
    taken_ = shared.sized_join(keyed(rows, "id", "source", seed), chosen, ["_h", "_g"], "inner")
    return taken_.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
