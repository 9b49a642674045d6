"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A token budget goes down a domain - language - source tree. At each node it is filled into the
children in proportion to their weights, up to what they can supply (their tokens times the number of
epochs allowed); what a child cannot take is shared again among its siblings by weight, and only
what all of them together cannot take goes to the siblings of their parent. Each leaf then reads its
documents in seeded orders, one order per epoch, and takes the prefix of that sequence that fits its
budget: whole epochs first, then the documents of the next order while their running token total
stays within the rest.

The running total of a leaf is never one window over the leaf: documents fall into about sqrt(n)
hash-ordered buckets per leaf, buckets before the cut are taken whole, and only the bucket at the
cut is summed row by row. So a source with a third of all rows costs two windows of sqrt(n) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.common import fresh, materialize

LEVELS = ("domain", "lang", "source")
NULL_NAME = "(null)"
WORDS = r"[^\x20\x09-\x0D]+"
DOMAINS = ("web", "news", "books", "forums")
#: weights of the registered query: by level and name, 1 where not named
WEIGHTS = {"domain": {"web": 2, "news": 4, "books": 3, "forums": 1}, "lang": {"en": 3, "de": 2}, "source": {"src0": 2}}
SEED = 17


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """A stand-in for a domain table: sources named ``src<n>`` are dealt over ``DOMAINS``, others are ``other``."""
    n = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.coalesce(F.get(names, F.pmod(n.try_cast("int"), F.lit(len(DOMAINS)))), F.lit("other"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    c = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        c = F.when(F.col(level) == name, F.lit(int(w))).otherwise(c)
    return c.cast("decimal(10,0)")


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """``alloc`` of each child: the parent's ``budget`` filled into ``cap`` in proportion to ``w``.

    Children in the order of cap / w: one is full if what is left for it and those after it, shared by
    weight, would exceed its capacity. Whole numbers throughout; a child with weight 0 gets nothing.
    """
    d = "decimal(20,0)"
    c = children.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0).cast(d))
    order = Window.partitionBy(*parent).orderBy(F.try_divide(F.col("cap").cast("double"), F.col("w").cast("double")).asc_nulls_last(), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parent)
    zero = F.lit(0).cast(d)
    c = (c.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero).cast(d))
         .withColumn("w_rest", (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), zero)).cast("decimal(18,0)")))
    full = (F.col("w") > 0) & ((F.col("budget").cast(d) - F.col("cap_before")) * F.col("w") >= F.col("cap") * F.col("w_rest"))
    c = c.withColumn("full", full)
    c = (c.withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(all_).cast(d))
         .withColumn("w_open", F.sum(F.when(F.col("full"), zero).otherwise(F.col("w"))).over(all_).cast("decimal(18,0)")))
    share = F.expr("(w * (cast(budget as decimal(20,0)) - used)) div w_open")
    return (c.withColumn("alloc", F.when(F.col("full"), F.col("cap").cast("long"))
                         .when(F.col("w_open") > 0, share).otherwise(F.lit(0)).cast("long"))
            .drop("cap_before", "w_rest", "full", "used", "w_open"))


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, n, supply) with ``alloc`` tokens, filled level by level."""
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    for level in LEVELS:
        caps = caps.withColumn(f"w_{level}", weight_of(level, weights))
    usable = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    caps = caps.withColumn("cap", F.when(usable, F.col("cap")).otherwise(F.lit(0)))
    node, parent = None, ["root"]
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        kids = caps.groupBy(*path, f"w_{level}").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("own")).withColumnRenamed(f"w_{level}", "w")
        kids = kids.withColumn("name", F.col(level))
        if node is None:  # the root's budget comes from the supply of all its children
            kids = kids.withColumn("root", F.lit(0))
            kids = kids.withColumn("all_supply", F.sum("own").over(Window.partitionBy("root"))).withColumn("budget", budget).drop("all_supply")
        else:
            kids = kids.join(node, parent)
        node = fill(kids, parent).select(*path, F.col("alloc").alias("budget"))
        parent = path
    return leaves.join(node.select(*LEVELS, F.col("budget").alias("alloc")), list(LEVELS))


def mix(docs: DataFrame, budget_permille: int = 600, max_epochs: int = 1, weights: dict | None = None, seed: int = SEED,
        domain: Column | None = None) -> DataFrame:
    """The documents chosen, with added columns ``mix_domain``, ``mix_tokens`` and ``mix_epoch`` (0-based).

    The budget is ``budget_permille`` thousandths of all tokens of the table. A document chosen in several epochs is
    returned once per epoch. Null languages and sources form leaves of their own, named ``(null)``;
    null and empty texts have no tokens and sort like any other; repeated rows are separate documents
    of equal rank. Added names that clash with columns of ``docs`` get a leading underscore.
    """
    weights = WEIGHTS if weights is None else weights
    domain = domain_of(F.col("source")) if domain is None else domain
    dom, lang, src, tok, epoch = fresh(docs.columns, "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch")
    base = (docs.withColumn(dom, F.coalesce(domain, F.lit(NULL_NAME)))
            .withColumn(lang, F.coalesce(F.col("lang").cast("string"), F.lit(NULL_NAME)))
            .withColumn(src, F.coalesce(F.col("source").cast("string"), F.lit(NULL_NAME))))
    leaf_cols = [F.col(dom).alias("domain"), F.col(lang).alias("lang"), F.col(src).alias("source")]
    digest = materialize(base.select(*leaf_cols, F.col("doc_id"), token_count(F.col("text")).alias("tokens"),
                                     F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("salt")), "mix-digest")
    leaves = materialize(digest.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("supply")), "mix-leaves")
    budget = F.expr(f"(all_supply * {int(budget_permille)}) div 1000")
    plan = leaf_budgets(leaves, budget, weights, max_epochs)
    whole = F.when(F.col("supply") > 0, F.expr("alloc div supply")).otherwise(F.lit(0)).cast("int")
    plan = materialize(plan.withColumn("epochs", whole)
                       .withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("supply"))
                       .withColumn("buckets", F.ceil(F.sqrt("n")).cast("long")), "mix-plan")

    def placed(d: DataFrame) -> DataFrame:
        d = d.withColumn("h", seeded_rank(seed, F.col("epochs"), F.col("doc_id"), F.col("salt")))
        return d.withColumn("bucket", F.shiftright(F.shiftright("h", 30) * F.col("buckets"), 30))

    sums = placed(digest.join(plan, list(LEVELS))).groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (sums.withColumn("upto", F.sum("t").over(run)).filter(F.col("upto") > F.col("rest"))
           .groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("taken"))).alias("c"))
           .select(*LEVELS, F.col("c")["bucket"].alias("cut"), F.col("c")["taken"].alias("taken")))
    plan = materialize(plan.join(cut, list(LEVELS), "left"), "mix-cuts")
    # rank by rank inside the cut buckets: the last rank whose running total still fits
    at_cut = placed(digest.join(plan, list(LEVELS))).filter(F.col("bucket") == F.col("cut"))
    ranks = at_cut.groupBy(*LEVELS, "taken", "rest", "h").agg(F.sum("tokens").alias("t"))
    rows = Window.partitionBy(*LEVELS).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = (ranks.withColumn("sum", F.col("taken") + F.sum("t").over(rows)).filter(F.col("sum") <= F.col("rest"))
            .groupBy(*LEVELS).agg(F.max("h").alias("last_h")))
    final = materialize(plan.join(last, list(LEVELS), "left")
                        .select(*LEVELS, "epochs", "buckets", "cut", "last_h"), "mix-final")
    return _choose(base, final, seed, (dom, lang, src, tok, epoch), docs.columns)


def seeded_rank(seed: int, epoch: Column, doc_id: Column, salt: Column) -> Column:
    """A document's rank in the order of one epoch: 60 bits of an MD5 over seed, epoch, id and text digest."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NULL_NAME)), salt))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _choose(base: DataFrame, final: DataFrame, seed: int, names: tuple, columns: list[str]) -> DataFrame:
    dom, lang, src, tok, epoch = names
    held = fresh(base.columns, *[f"mix_{c}" for c in ("leaf_domain", "leaf_lang", "leaf_source", "epochs", "buckets", "cut", "last_h")])
    d_, l_, s_, epochs, buckets, cut, last_h = held
    final = final.toDF(*held)
    rank, last = fresh(base.columns + held, "mix_rank", "mix_last")
    d = base.join(final, (F.col(dom) == F.col(d_)) & (F.col(lang) == F.col(l_)) & (F.col(src) == F.col(s_)))
    d = d.withColumn(rank, seeded_rank(seed, F.col(epochs), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    bucket = F.shiftright(F.shiftright(rank, 30) * F.col(buckets), 30)
    inside = F.col(cut).isNull() | (bucket < F.col(cut)) | F.coalesce(F.col(rank) <= F.col(last_h), F.lit(False))
    d = d.withColumn(last, F.when(inside, F.col(epochs)).otherwise(F.col(epochs) - 1)).filter(F.col(last) >= 0)
    d = d.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(last))))
    return d.select(*columns, F.col(dom), token_count(F.col("text")).alias(tok), F.col(epoch))
