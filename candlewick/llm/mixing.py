"""Mixing sources to target weights over a tree (operator 9).

Leaves are domain / language / source. A budget of words flows from the root down: each
node's share is dealt to its children by weight, a child that cannot use its part (its
texts, read `max_epochs` times, hold fewer words) is filled up, and what it leaves goes to
its siblings by weight; only what all siblings together cannot use has been kept from the
parent's own share and so went to the parent's siblings. All sums are whole numbers, so
results do not depend on the order of additions; up to one word a child is lost to rounding.

A leaf's share is read in epochs. Each epoch puts the leaf's documents in the order of an
MD5 of seed, epoch and doc_id; whole epochs come first, of the last one the longest prefix
that fits is taken. The prefix is found by sums over PIECES of the order and then inside one
piece, so no task sorts a whole leaf.

Defined results: a null text has no words; null levels are levels of their own (shown as
null); rows that share a doc_id share their place in every order and are taken together; a
weight of zero takes nothing; a leaf without words is taken whole or not at all (its
documents cost nothing: they come with max_epochs copies if its weight is not zero); an
empty table gives no rows; other columns pass through `mixed_documents` and are ignored
elsewhere.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

LEVELS = ("domain", "lang", "source")
#: Up to so many leaves their cuts are sent to every executor; beyond, they are joined.
SMALL = 50_000
#: An order is summed in 16 ** 3 pieces first.
PIECE_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """weights: for each level, name -> whole-number weight; others weigh `default`."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}})
    default: int = 1
    share: float = 0.6
    max_epochs: int = 2
    seed: int = 7


def domain_of(source: Column) -> Column:
    """The domain of a source of the test tables, by the number in its name."""
    n = F.regexp_extract(source, r"(\d+)$", 1).cast("long") % 3
    return F.when(n == 1, "books").when(n == 2, "forum").otherwise("web")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    pairs = sorted(mix.weights.get(level, {}).items())
    return reduce(lambda e, kv: e.when(F.col(level) == kv[0], kv[1]), pairs[1:], F.when(F.col(level) == pairs[0][0], pairs[0][1])).otherwise(mix.default).cast("long") if pairs else F.lit(mix.default).cast("long")


def _dealt(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent keys, name, w, cap, budget of the parent) with each node's share.

    In ascending order of cap / w, a node is filled as long as its cap is at most its part of
    what is left: filled ones come first, the others share the rest by weight."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = nodes.withColumn("before", before).withColumn("onward", onward).withColumn("full", F.col("cap") * F.col("onward") <= (F.col("budget") - F.col("before")) * F.col("w"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by)
    out = full.withColumn("rest", rest).withColumn("open_w", open_w)
    return out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("rest * w div open_w"))).drop("before", "onward", "full", "rest", "open_w", "budget")


def leaf_shares(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(levels, words) of every leaf -> with its share of the budget in words."""
    leaves = sizes.withColumn("cap", F.col("words") * mix.max_epochs)
    weights = {k: _weight(k, mix) for k in LEVELS}
    for k in LEVELS:
        leaves = leaves.withColumn(f"w_{k}", weights[k])
    leaves = leaves.withColumn("cap", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("cap")).otherwise(0))
    root = sizes.agg(F.floor(F.sum("words") * F.lit(mix.share)).cast("long").alias("budget"))
    above, parent = root, []
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w_{name}").alias("w")).where("cap > 0")
        nodes = nodes.join(above, parent) if parent else nodes.withColumn("budget", root.scalar())
        above = _dealt(nodes, parent, name).select(*keys, F.col("share").alias("budget"))
        parent = keys
    return sizes.join(above, list(LEVELS), "left").withColumn("share", F.coalesce("budget", F.lit(0))).drop("budget")


def _order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def cuts(slim: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf: whole epochs, and up to which order key the next one is taken.
    slim: doc_id, levels (no nulls), words."""
    sizes = slim.groupBy(*LEVELS).agg(F.sum("words").alias("words"))
    shares = leaf_shares(sizes, mix)
    whole = F.when(F.col("words") > 0, F.least(F.expr("share div words"), F.lit(mix.max_epochs))).otherwise(F.when((_weight("domain", mix) > 0) & (_weight("lang", mix) > 0) & (_weight("source", mix) > 0), mix.max_epochs).otherwise(0))
    plan = shares.withColumn("epochs", whole.cast("long")).withColumn("left", F.when(F.col("epochs") < mix.max_epochs, F.col("share") - F.col("epochs") * F.col("words")).otherwise(0))
    plan, _ = written(plan.select(*LEVELS, "epochs", "left"), "shares")
    keyed = _with_plan(slim, plan.where("left > 0"), "inner").withColumn("key", _order_key(mix, F.col("epochs"), F.col("doc_id"))).withColumn("piece", F.substring("key", 1, PIECE_DIGITS))
    pieces = keyed.groupBy(*LEVELS, "piece", "left").agg(F.sum("words").alias("words"))
    run = Window.partitionBy(*LEVELS).orderBy("piece")
    pieces = pieces.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    last = pieces.where("before <= left and upto > left").select(*LEVELS, F.col("piece").alias("cut_piece"), "before")
    inside = _with_plan(keyed, last, "inner").where("piece = cut_piece")
    upto = F.col("before") + F.sum("words").over(Window.partitionBy(*LEVELS).orderBy("key"))  # rows of one key count together
    ends = inside.withColumn("upto", upto).where("upto <= left").groupBy(*LEVELS).agg(F.max("key").alias("cut_key"))
    out = plan.join(last.drop("before"), list(LEVELS), "left").join(ends, list(LEVELS), "left")
    # everything before the piece is taken; inside it, keys up to the cut; without a piece, the rest fits whole
    cut = F.when(F.col("left") <= 0, F.lit("")).when(F.col("cut_piece").isNull(), F.lit("g")).otherwise(F.coalesce("cut_key", "cut_piece"))
    return written(out.select(*LEVELS, "epochs", cut.alias("cut")), "cuts")[0]


def _with_plan(df: DataFrame, plan: DataFrame, how: str) -> DataFrame:
    """Joined by leaf; the plan is sent out whole only if it is small, else large leaves are
    for adaptive execution to split."""
    return df.join(F.broadcast(plan) if plan.limit(SMALL + 1).count() <= SMALL else plan, list(LEVELS), how)


def _copies(mix: Mix, doc_id: Column) -> Column:
    return F.col("epochs") + F.when(_order_key(mix, F.col("epochs"), doc_id) <= F.col("cut"), 1).otherwise(0)


def _named(c: Column) -> Column:
    """A level without null: "=" and the name, or "null"."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _slim(docs: DataFrame, id_col: str, text_col: str, lang: Column, source: Column, domain: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), domain.alias("domain"), lang.cast("string").alias("lang"), source.cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("words"))


def _marked(mix: Mix) -> Mix:
    return Mix({k: {f"={n}": w for n, w in v.items()} for k, v in mix.weights.items()}, mix.default, mix.share, mix.max_epochs, mix.seed)


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, domain, lang, source, n_words, n_copies) of every document that is taken."""
    slim, _ = written(_slim(docs, id_col, text_col, F.col("lang"), F.col("source"), domain_of(F.col("source"))), "slim")
    safe = slim.select("doc_id", *(_named(F.col(k)).alias(k) for k in LEVELS), "words")
    plan, own = cuts(safe, _marked(mix)), _marked(mix)
    out = _with_plan(safe, plan, "inner").withColumn("n_copies", _copies(own, F.col("doc_id"))).where("n_copies > 0")
    shown = [F.when(F.col(k) != "null", F.substring(k, 2, 1 << 30)).alias(k) for k in LEVELS]
    return out.select("doc_id", *shown, F.col("words").alias("n_words"), F.col("n_copies").cast("long").alias("n_copies"))


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are taken, each as often as it is read, with their columns. The
    cuts are applied where the texts are read; no text is moved."""
    names = {k: f"_{k}_{uuid.uuid4().hex}" for k in (*LEVELS, "epochs", "cut", "copy")}
    slim, _ = written(_slim(docs, id_col, text_col, F.col("lang"), F.col("source"), domain_of(F.col("source"))).select("doc_id", *(_named(F.col(k)).alias(k) for k in LEVELS), "words"), "slim")
    own = _marked(mix)
    plan = cuts(slim, own).withColumnsRenamed({k: names[k] for k in (*LEVELS, "epochs", "cut")})
    small = plan.limit(SMALL + 1).count() <= SMALL
    levels = {"domain": domain_of(docs["source"]), "lang": docs["lang"], "source": docs["source"]}
    on = reduce(lambda a, b: a & b, (_named(levels[k]) == F.col(names[k]) for k in LEVELS))
    n = F.col(names["epochs"]) + F.when(_order_key(own, F.col(names["epochs"]), docs[id_col]) <= F.col(names["cut"]), 1).otherwise(0)
    taken = docs.join(F.broadcast(plan) if small else plan, on).withColumn(names["copy"], n).where(F.col(names["copy"]) > 0)
    columns = [taken[c] for c in docs.columns]
    if mix.max_epochs == 1:
        return taken.select(*columns)
    return taken.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copy"]).cast("int")))).select(*columns)
