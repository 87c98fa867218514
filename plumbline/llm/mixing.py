"""Mixing sources to target shares of all tokens.

A tree of groups carries weights: domains, their languages, and in each language its sources. A leaf weighs its source's target, divided among the source's leaves by their
tokens; a language and a domain weigh what their leaves do, so as long as nothing runs short every source has its share exactly. The budget of the whole
mixture is handed down the tree: every node shares its budget among its children by their weights; what a child cannot take, as its documents times max_repeats end, goes to its
siblings (other sources of the language), and only what all siblings together cannot take goes to the parent's siblings (other languages, then other domains). Each leaf
then takes whole epochs of its documents and a prefix of one more, in an order drawn anew for each epoch from a seed. What a leaf's last
document is too much or too little is carried on to the next leaf of its source.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.tokens import token_counts
from plumbline.session import scratch

BUCKET_BITS = 10


@dataclass
class Node:
    """A group of the tree. share: its target among its siblings. capacity: tokens it can give, repeats counted in."""

    name: tuple[str, ...]
    share: float
    capacity: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0


def spread(nodes: list[Node], budget: float) -> float:
    """Shares the budget among siblings by weight, shortages redistributed among those that can take more; returns what none can take."""
    for n in nodes:
        n.budget = 0.0
    left, open_ = budget, [n for n in nodes if n.capacity > 0 and n.share > 0]
    while open_ and left > 1e-9 * max(budget, 1.0):
        total = sum(n.share for n in open_)
        short = [n for n in open_ if n.budget + left * n.share / total >= n.capacity - 1e-9]
        if not short:
            for n in open_:
                n.budget += left * n.share / total
            left = 0.0
            break
        # Those that would overflow are filled up, the others wait for the next turn with what then is left.
        for n in short:
            left -= n.capacity - n.budget
            n.budget = n.capacity
        open_ = [n for n in open_ if n not in short]
    for n in nodes:
        if n.children:
            left += spread(n.children, n.budget)
    return left


def primary_language(c: Column) -> Column:
    """The language's first subtag in lower case; und where there is none of two or three letters."""
    tag = F.lower(F.element_at(F.split(F.trim(c), "[-_]"), 1))
    return F.when(F.coalesce(tag.rlike("^[a-z]{2,3}$"), F.lit(False)), tag).otherwise(F.lit("und"))


def budgets(leaves: Iterable[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: float | str | None) -> tuple[list[Node], float]:
    """Leaf nodes (domain, language, source) with their budgets, and the mixture's size.

    leaves: domain, language, source, tokens. total None: the largest at which every source that has documents reaches its share (those without give theirs to the others).
    """
    held = sorted(x for x in leaves if x[2] in targets and x[3] > 0)
    once: dict[str, int] = {}
    for _, _, s, n in held:
        once[s] = once.get(s, 0) + n
    root = Node((), 1.0)
    for d, lang, s, n in held:
        at = root
        for name in ((d,), (d, lang)):
            if not at.children or at.children[-1].name != name:
                at.children.append(Node(name, 0.0))
            at = at.children[-1]
        share, repeats = targets[s]
        at.children.append(Node((d, lang, s), share * n / once[s], float(n) * repeats))
    for dom in root.children:
        for lang in dom.children:
            lang.share, lang.capacity = sum(x.share for x in lang.children), sum(x.capacity for x in lang.children if x.share > 0)
        dom.share, dom.capacity = sum(x.share for x in dom.children), sum(x.capacity for x in dom.children)
    root.capacity = sum(x.capacity for x in root.children)
    able = {s: (targets[s][0], float(n) * targets[s][1]) for s, n in once.items() if targets[s][0] > 0 and targets[s][1] > 0}
    shares = sum(share for share, _ in able.values())
    if total is None:
        size = min((capacity * shares / share for share, capacity in able.values()), default=0.0)
    else:
        size = float(sum(once.values())) if total == "corpus" else float(total)
    spread([root], min(size, root.capacity))
    return [x for dom in root.children for lang in dom.children for x in lang.children], size


def rounded(borders: Iterable[tuple[tuple[str, ...], float, int]]) -> dict[tuple[str, ...], bool]:
    """Which leaves take the document on their border. borders: leaf (its source last), tokens still due before that document, its tokens.

    From the largest such document of a source to the smallest, each is taken if that brings the sum of what was taken nearer to what was due: what is over or under is carried on, and in the
    end a source is off by at most about half of its smallest border document.
    """
    take: dict[tuple[str, ...], bool] = {}
    carry: dict[str, float] = {}
    for leaf, due, size in sorted(borders, key=lambda b: (-b[2], b[0])):
        over = carry.get(leaf[-1], 0.0) - due
        take[leaf] = abs(over + size) <= abs(over)
        carry[leaf[-1]] = over + size * take[leaf]
    return take


def mixture(docs: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 7, path: str | None = None, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report, both from one count of the tokens.

    mixture: doc_id, source, lang, n_tokens, copies: how often each chosen document is used, never above its source's max_repeats.
    report: source, target_share, max_repeats, n_docs, n_tokens (once), taken_tokens, actual_share, short (true where the source
    is used up, all documents max_repeats times).

    Sizes are tokens of the whole texts. total: the mixture's size in tokens; None: the largest size at which every source that has documents reaches its
    share ("corpus": as many tokens as the targeted sources hold once), so the shares are as near to the targets as documents and repeats allow. A given total may be more than that; sources that
    run short then leave their part to the others of their languages first. domain: a column that parts the documents above their languages (null is a value of its own); None: one domain holds all. Targets must be
    few (one row a source; the driver reads them); the sums and border documents of the leaves it reads are bounded by domains times languages of two or three letters times sources.

    Sources not in targets, and null ones, are left out. Sources of targets without documents get nothing, and their share goes to the
    others. Texts without tokens are never taken. Rows that repeat a doc_id are documents of their own. Empty input: empty mixture.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "mix")
    aims = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    wanted = {r.source: (float(r.target_share or 0.0), int(r.max_repeats or 0)) for r in aims.collect()}
    # Counted once: the sizes are needed for the budgets, the prefixes and the choice.
    dom = F.lit("all") if domain is None else F.coalesce(F.col(domain).cast("string"), F.lit("none"))
    meta = docs.where(F.col("source").isin(*wanted)).select(F.struct("doc_id", "source", primary_language(F.col("lang")).alias("lang"), dom.alias("domain")).alias("doc"), "text")
    token_counts(meta, "doc", "text", path).select("doc.*", "n_tokens").write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes").where("n_tokens > 0")

    leaf_cols = ["domain", "lang", "source"]
    held = {(r.domain, r.lang, r.source): r.n for r in sizes.groupBy(*leaf_cols).agg(F.sum("n_tokens").alias("n")).collect()}
    rows = []
    for leaf in budgets([(*k, n) for k, n in held.items()], wanted, total)[0]:
        n = held[leaf.name]
        epochs = min(int(leaf.budget / n + 1e-9), wanted[leaf.name[-1]][1])
        rows.append((*leaf.name, epochs, max(0.0, leaf.budget - epochs * n)))
    plan = spark.createDataFrame(rows, "domain string, lang string, source string, epochs int, rest double")

    # The order of a leaf's next epoch: a seeded hash of 64 bits. Its first bits make buckets, so that no leaf is ever sorted as a whole.
    drawn = F.xxhash64(F.lit(seed), *(F.col(c) for c in leaf_cols), F.col("epochs"), F.col("doc_id"))
    placed = sizes.join(plan, leaf_cols).withColumn("__h", drawn).withColumn("__b", F.shiftrightunsigned("__h", 64 - BUCKET_BITS).cast("int"))
    per = placed.groupBy(*leaf_cols, "__b").agg(F.sum("n_tokens").alias("__in"))
    leaf = Window.partitionBy(*leaf_cols).orderBy("__b")
    before = per.select(*leaf_cols, "__b", "__in", (F.sum("__in").over(leaf) - F.col("__in")).alias("__before"))
    at = placed.join(before, [*leaf_cols, "__b"])
    # Buckets wholly within the rest, or wholly beyond it, are settled; only the one on the border is put in order.
    inside = F.col("__before") + F.col("__in") <= F.col("rest")
    border = ~inside & (F.col("__before") < F.col("rest"))
    in_order = Window.partitionBy(*leaf_cols, "__b").orderBy("__h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = at.where(border).withColumn("__due", F.col("rest") - (F.col("__before") + F.sum("n_tokens").over(in_order) - F.col("n_tokens")))
    last = (F.col("__due") > 0) & (F.col("__due") < F.col("n_tokens"))  # one document a leaf at most
    take = rounded(((r.domain, r.lang, r.source), r.due, r.n) for r in edge.where(last).select(*leaf_cols, F.col("__due").alias("due"), F.col("n_tokens").alias("n")).collect())
    choice = spark.createDataFrame([(*k, v) for k, v in take.items()], "domain string, lang string, source string, __take boolean")
    settled = at.where(~border).withColumn("__more", inside.cast("int"))
    edge = edge.join(choice, leaf_cols, "left").withColumn("__more", (F.when(last, F.coalesce("__take", F.lit(False))).otherwise(F.col("__due") > 0)).cast("int"))
    keep = ["doc_id", "source", "lang", "n_tokens", "epochs", "__more"]
    chosen = settled.select(*keep).unionByName(edge.select(*keep)).withColumn("copies", F.col("epochs") + F.col("__more")).where("copies > 0")
    chosen = chosen.select("doc_id", "source", "lang", "n_tokens", F.col("copies").cast("int").alias("copies"))

    once = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    everything = got.agg(F.sum("taken_tokens")).scalar()
    report = (
        aims.join(once, "source", "left")
        .join(got, "source", "left")
        .select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_tokens"), zero("taken_tokens"))
        .select("*", F.coalesce(F.col("taken_tokens") / everything, F.lit(0.0)).alias("actual_share"), (F.col("taken_tokens") >= F.col("n_tokens") * F.col("max_repeats")).alias("short"))
    )
    return chosen, report
