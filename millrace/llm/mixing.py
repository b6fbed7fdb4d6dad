"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain - language - source. A token budget flows from the root: children share it by
their weights, none takes more than its subtree can give (its tokens times the epochs allowed), and what one
cannot take goes to its siblings. Because a subtree's limit is known before it is filled, siblings are served
before any shortage reaches an ancestor. A leaf spends its budget on whole seeded epochs and then on the longest
prefix of the next epoch's order that fits.

The order of an epoch is that of md5(seed:epoch:doc_id). Prefixes are found without sorting a leaf: tokens are
summed by the next digits of the digest, the bucket that holds the cut is divided again, and only a bucket of few
rows is sorted.

Tokens are words here (runs without ASCII white space), at least one for a text; the column is a parameter.

Defined results: a null text counts as empty (one token); null language or source form leaves of their own
(`~`); repeated rows are chosen alike, as copies; ties in the order go by doc_id, and rows with equal doc_id
are taken or left together; unknown domains, languages and sources weigh as little as the least listed one of
their level (1 where none is listed); very long texts are counted whole and, like all others, taken or left whole;
an empty table or a zero weight gives no rows; extra columns are carried along by mix() under whatever names, and
it finds the chosen rows by doc_id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import documents, materialise, small

LEVELS = ("domain", "language", "origin")
#: Hex digits of the digest by which a leaf's tokens are summed at a time, and the rows of a bucket that is sorted.
DIGITS, SORTED_ROWS = 2, 256

#: Production weights: the parts of the corpus by domain, and languages within each.
DOMAIN_WEIGHTS = {"bulk": 0.25, "d0": 0.2, "d1": 0.2, "d2": 0.2, "d3": 0.15}
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.6, 2, 17


def domain_of(source: Column) -> Column:
    """The driver's corpus names no domains: its largest source is one, the others are dealt by number."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.when(source == "src0", "bulk").when(source.isNotNull(), F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")))


def words_in(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def _other(weights: Mapping[str, float]) -> float:
    """The weight of what is not listed."""
    return float(min(weights.values(), default=1.0))


def _weight(level: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(_other(weights))
    for k, v in weights.items():
        out = F.when(level == k, float(v)).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """children: parent columns, child, weight, limit, budget (of the parent). Adds `given`: weighted shares, capped by limit.

    Ordered by limit / weight, the children at their limit come first; each of the others gets its weight times one level."""
    order = Window.partitionBy(*parent).orderBy((F.col("limit") / F.col("weight")).asc(), "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    out = children.where("weight > 0")
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    out = out.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    everyone = Window.partitionBy(*parent)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everyone), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    share = F.when(F.col("full"), F.col("limit")).otherwise((F.col("budget") - spent) * F.col("weight") / open_)
    return out.withColumn("given", share).drop("level", "full")


def leaf_budgets(leaves: DataFrame, total: Column | float, weights: Mapping[str, Mapping[str, float]], max_epochs: int) -> DataFrame:
    """leaves: domain, language, origin, tokens. Adds `given`, the tokens that each leaf may spend."""
    current = leaves.withColumn("limit", (F.col("tokens") * max_epochs).cast("double"))
    budget = F.lit(total) if isinstance(total, int | float) else total
    placed = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[:depth])
        nodes = current.groupBy(*keys, level).agg(F.sum("limit").alias("limit")).withColumn("child", F.col(level)).withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        if placed is None:
            nodes = nodes.withColumn("budget", budget.cast("double")).withColumn("root", F.lit(0))
            placed = fill(nodes, ["root"])
        else:
            placed = fill(nodes.join(placed.select(*keys, F.col("given").alias("budget")), keys), keys)
        placed = placed.select(*keys, level, "given")
    return leaves.join(placed, list(LEVELS))


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, float]],
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    added: tuple[str, str, str] | None = ("mix_domain", "mix_tokens", "mix_epoch"),
) -> DataFrame:
    """docs, one row for each time that a document is used, with its domain, tokens and epoch in the columns `added`.

    The budget is budget_share of all tokens; max_epochs bounds how often one document is used. Names of docs itself
    cannot be added."""
    if taken := set(added or ()) & set(docs.columns):
        raise ValueError(f"docs has columns named {sorted(taken)}; choose other names to add")
    tag = {"domain": domain_of(F.col(source_col)), "language": F.col(lang_col), "origin": F.col(source_col)}
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    named = {prefix + k: F.coalesce(v, F.lit("~")) for k, v in tag.items()} | {prefix + "tokens": words_in(F.col(text_col))}
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(v.alias(k.removeprefix(prefix)) for k, v in named.items()))
    chosen = materialise(choose(materialise(narrow, "mix-tokens"), weights, budget_share, max_epochs, seed), "mix-chosen")
    chosen = chosen.groupBy("doc_id").agg(F.collect_set("epoch").alias(prefix + "epochs")).withColumnRenamed("doc_id", prefix + "id")
    out = docs.join(small(chosen), docs[id_col].cast("long").eqNullSafe(F.col(prefix + "id")))
    values = (F.coalesce(tag["domain"], F.lit("~")), named[prefix + "tokens"], F.col(prefix + "epoch"))
    out = out.withColumn(prefix + "epoch", F.explode(prefix + "epochs"))
    return out.select(*(docs[c] for c in docs.columns), *(v.alias(n) for n, v in zip(added or (), values, strict=False)))


def choose(rows: DataFrame, weights: Mapping[str, Mapping[str, float]], budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """rows: doc_id, domain, language, origin, tokens. Adds epoch: one row for each use."""
    keys = list(LEVELS)
    leaves = materialise(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    n_leaves = leaves.count()
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budgets = leaf_budgets(leaves, float(total) * budget_share, weights, max_epochs)
    budgets = budgets.withColumn("whole", F.least(F.lit(max_epochs), F.floor(F.round(F.col("given") / F.col("tokens"), 9)))).withColumn("left", F.greatest(F.lit(0.0), F.round(F.col("given") - F.col("whole") * F.col("tokens"), 6)))
    budgets = materialise(budgets.select(*keys, F.col("whole").cast("int").alias("whole"), "left"), "mix-budgets")
    rows = rows.join(small(budgets, n_leaves), keys)
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), "whole"))).select("doc_id", *keys, "tokens", "epoch")

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))).cast("binary"))
    partial = materialise(rows.where(f"left > 0 and whole < {max_epochs}").select("doc_id", *keys, "tokens", "whole", "left", digest.alias("digest")), "mix-order")
    cuts = _cuts(partial, n_leaves)
    partial = partial.join(small(cuts, n_leaves), keys, "left")
    before = partial.where("at is null or digest < at")
    last = partial.where("startswith(digest, at)")
    order = Window.partitionBy(*keys).orderBy("digest")  # of about SORTED_ROWS documents a leaf
    ends = last.groupBy(*keys, "digest", "left", "below").agg(F.sum("tokens").alias("n")).withColumn("upto", F.col("below") + F.sum("n").over(order))
    fitting = last.join(small(ends.where("upto <= left").select(*keys, "digest")), [*keys, "digest"], "left_semi")
    taken = before.select("doc_id", *keys, "tokens", "whole").unionByName(fitting.select("doc_id", *keys, "tokens", "whole"))
    return full.unionByName(taken.select("doc_id", *keys, "tokens", (F.col("whole") + 1).alias("epoch")))


def _cuts(partial: DataFrame, n_leaves: int) -> DataFrame:
    """Of each leaf that does not fit whole: how the digests begin (`at`) among which the last one that fits lies, and the tokens below those.

    Each round sums by DIGITS more digits of what begins like the bucket of the round before: 16 ** DIGITS rows a leaf, until buckets are small."""
    keys, depth = list(LEVELS), 0
    open_ = partial.withColumn("below", F.lit(0).cast("long"))
    while True:
        depth += DIGITS
        sums = open_.groupBy(*keys, F.substring("digest", 1, depth).alias("at"), "left", "below").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        sums = sums.withColumn("upto", F.col("below") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("at")))
        first = F.min(F.struct("at", (F.col("upto") - F.col("tokens")).alias("below"), "n")).alias("c")
        cuts = materialise(sums.where("upto > left").groupBy(*keys).agg(first).select(*keys, "c.at", "c.below", "c.n"), "mix-cuts")
        if (cuts.agg(F.max("n")).first()[0] or 0) <= SORTED_ROWS or depth >= 32:
            return cuts.drop("n")
        open_ = partial.join(small(cuts.drop("n"), n_leaves), keys).where("startswith(digest, at)").drop("at")


WEIGHTS = {"domain": DOMAIN_WEIGHTS, "language": LANGUAGE_WEIGHTS}


def op6(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.coalesce(domain_of(F.col("source")), F.lit("~")).alias("domain"),
        F.coalesce("lang", F.lit("~")).alias("language"),
        F.coalesce("source", F.lit("~")).alias("origin"),
        words_in(F.col("text")).alias("tokens"),
    )
    return choose(materialise(rows, "mix-tokens"), WEIGHTS, BUDGET_SHARE, MAX_EPOCHS, SEED)


def _filled(name: str, source: str, parent: str, child: str) -> str:
    """SQL views that end in `name`: source (parent, child, w, lim, budget) with `given`."""
    order = f"partition by {parent} order by lim / w, {child}"
    return f"""
{name}_a as (select *, (budget - coalesce(sum(lim) over ({order} rows between unbounded preceding and 1 preceding), 0)) / sum(w) over ({order} rows between current row and unbounded following) as level from {source}),
{name}_b as (select *, lim <= level * w as is_full from {name}_a),
{name} as (select *, case when is_full then lim else (budget - coalesce(sum(case when is_full then lim end) over (partition by {parent}), 0)) * w / sum(case when not is_full then w end) over (partition by {parent}) end as given from {name}_b)"""


def _sql_weight(column: str, weights: Mapping[str, float]) -> str:
    return f"case {column} {' '.join(f"when '{k}' then {v}" for k, v in weights.items())} else {_other(weights)} end::double"


#: The same rows in SQL, every epoch's order sorted whole.
ORACLE = rf"""
with t as (select doc_id, case when source is null then '~' when source = 'src0' then 'bulk' else 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as int), 0) % 4) end as domain,
  coalesce(lang, '~') as language, coalesce(source, '~') as origin, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) as tokens from documents),
lf as (select domain, language, origin, sum(tokens)::double as tokens from t group by all),
s1 as (select 0 as root, domain, {_sql_weight("domain", DOMAIN_WEIGHTS)} as w, sum(tokens) * {MAX_EPOCHS} as lim, (select sum(tokens) from lf) * {BUDGET_SHARE} as budget from lf group by domain),{_filled("f1", "s1", "root", "domain")},
s2 as (select x.domain, language, {_sql_weight("language", LANGUAGE_WEIGHTS)} as w, lim, given as budget from (select domain, language, sum(tokens) * {MAX_EPOCHS} as lim from lf group by all) x join (select domain, given from f1) using (domain)),{_filled("f2", "s2", "domain", "language")},
s3 as (select domain, language, origin, tokens, 1.0::double as w, tokens * {MAX_EPOCHS} as lim, given as budget from lf join (select domain, language, given from f2) using (domain, language)),{_filled("f3", "s3", "domain, language", "origin")},
b as (select domain, language, origin, least({MAX_EPOCHS}, floor(round(given / tokens, 9)))::int as whole, given, tokens as have from f3),
c as (select domain, language, origin, whole, greatest(0.0, round(given - whole * have, 6)) as rest from b),
r as (select t.*, whole, rest from t join c using (domain, language, origin)),
p as (select *, sum(tokens) over (partition by domain, language, origin order by md5('{SEED}:' || (whole + 1) || ':' || coalesce(doc_id::varchar, '~')), doc_id) as upto from r where whole < {MAX_EPOCHS})
select doc_id, domain, language, origin, tokens, unnest(range(1, whole + 1))::int as epoch from r where whole > 0
union all select doc_id, domain, language, origin, tokens, (whole + 1)::int from p where upto <= rest"""
