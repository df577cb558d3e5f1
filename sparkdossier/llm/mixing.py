"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

The leaves of a tree (domain, language, source) hold tokens; each node has a weight among its siblings. A token budget
goes down the tree: siblings share their parent's budget by weight, none gets more than its leaves can supply in
``max_epochs`` passes, and what one cannot use goes to its siblings. Since a node's supply is the sum of its leaves, a
shortage is first made up inside the subtree where it arises, and reaches an ancestor's siblings only when the whole
subtree is used up. Each leaf then takes whole passes over its documents and a prefix of the tokens of one more, in an order seeded
by the number of passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdossier.session import cut

LEVELS = ("domain", "language", "origin")
#: Budgets are broadcast up to so many leaves; beyond, rows are joined to them by a shuffle that can be split.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers; a node not listed has weight 1), passes at most, seed, and the domain of a row."""

    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    origins: dict[str, int] = field(default_factory=dict)
    max_epochs: int = 4
    seed: str = "mix"
    domain_sql: str = "concat('domain', CAST(crc32(CAST(coalesce(source, '') AS BINARY)) % 4 AS STRING))"
    #: Budget as a share of the tokens there are, in thousandths.
    budget_milli: int = 1000


MIX = Mix({"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, {"en": 3, "de": 2, "fr": 2, "es": 2})


def token_count(text: str = "text") -> F.Column:
    """Words between blanks; 0 for a null text."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^ \\\\t\\\\n\\\\r]+')"), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int]) -> F.Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``tokens`` of each leaf to the tokens to take, ``take``."""
    weights = dict(zip(LEVELS, (mix.domains, mix.languages, mix.origins), strict=True))
    supply = leaves.withColumn("supply", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.coalesce(F.floor(F.sum("tokens") * F.lit(mix.budget_milli) / 1000), F.lit(0)).cast("long").alias("budget"))
    given, parents = total, []
    for level in LEVELS:
        keys = [*parents, level]
        nodes = supply.groupBy(*keys).agg(F.sum("supply").cast("long").alias("supply")).withColumn("w", _weight(level, weights[level]))
        nodes = nodes.join(given, parents) if parents else nodes.crossJoin(F.broadcast(given))  # one row on the right
        nodes = nodes.withColumn("ratio", F.col("supply") / F.col("w"))
        up = Window.partitionBy(*parents or [F.lit(0)]).orderBy("ratio", level)
        before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("used", F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("rest_w", F.sum("w").over(after))
        # In order of supply per weight the nodes that their share would more than fill come first.
        big = "CAST({} AS DECIMAL(19, 0))"
        full = F.expr(f"{big.format('supply')} * {big.format('rest_w')} <= {big.format('w')} * {big.format('greatest(budget - used, 0)')}")
        nodes = nodes.withColumn("full", full)
        same = Window.partitionBy(*parents or [F.lit(0)])
        nodes = nodes.withColumn("left", F.greatest(F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(same), F.lit(0)), F.lit(0)))
        nodes = nodes.withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(same))
        nodes = nodes.withColumn("cum_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(up.rowsBetween(Window.unboundedPreceding, 0)))
        share = f"{big.format('cum_w')} * {big.format('left')} div open_w - {big.format('cum_w - w')} * {big.format('left')} div open_w"
        nodes = nodes.withColumn("got", F.when(F.col("full"), F.col("supply")).otherwise(F.least(F.col("supply"), F.expr(share))))
        given, parents = nodes.select(*keys, F.col("got").alias("budget")), keys
    return leaves.join(given, list(LEVELS)).withColumnRenamed("budget", "take")


def _leaf(mix: Mix) -> list[F.Column]:
    return [F.expr(mix.domain_sql).alias("domain"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("origin")]


def slice_digits(rows: F.Column) -> F.Column:
    """Hex digits that deal so many rows into slices of about 50,000, three at least."""
    return F.greatest(F.lit(3), F.ceil(F.log(16.0, F.greatest(rows, F.lit(1)) / 50_000)).cast("int"))


def repeated(rows: DataFrame, times: str, number: str = "mix_i", few: int = 256) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 1.

    More than ``few`` are made in parts of ``few``, dealt anew, so that neither an array nor a task holds all of a row's repeats.
    """
    small = rows.where(f"{times} between 1 and {few}").withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    parts = rows.where(f"{times} > {few}").withColumn("mix_part_of", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {few}"))))
    parts = parts.repartition("mix_part_of", times)
    first, last = F.col("mix_part_of") * few + 1, F.least(F.col(times), (F.col("mix_part_of") + 1) * few)
    big = parts.withColumn(number, F.explode(F.sequence(first, last))).drop("mix_part_of")
    return small.unionByName(big)


def _drawn(docs: DataFrame, mix: Mix, *texts: F.Column) -> DataFrame:
    """One row per leaf, doc_id, token count (and text): ``n`` rows of it, whole passes, and what the prefix takes of them.

    Rows alike in all of these are interchangeable, so they are counted first and stand beside each other in the order; neither
    a repeated nor a null doc_id fills a slice. The prefix takes ``n_full`` of them whole and ``part`` tokens of one more.
    """
    # Words are counted once; what follows reads the written counts.
    counted = docs.select("doc_id", *_leaf(mix), token_count().alias("tokens"), *texts)
    d = cut(counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("n")))
    more = [c for c in d.columns if c not in ("doc_id", *LEVELS, "tokens", "n")]
    leaves = d.groupBy(*LEVELS).agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.count(F.lit(1)).alias("n_rows")).where("tokens > 0")
    plan = cut(budgets(leaves, mix).select(*LEVELS, F.expr("take div tokens").alias("whole"), F.expr("take % tokens").alias("rest"), slice_digits(F.col("n_rows")).alias("digits")))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan

    # The order key's first hex digits deal a leaf into slices, more of them the more rows it has; sums of slices find the one
    # in which the prefix ends, so that no leaf is ever sorted or summed in one task.
    key = F.md5(F.concat_ws("|", F.lit(mix.seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = d.join(plan, list(LEVELS)).withColumn("key", key).withColumn("slice", F.expr("substring(key, 1, digits)")).withColumn("sum", F.col("tokens") * F.col("n"))
    # They are summed in two steps, blocks of slices and then slices, so that a window holds about the root of their number.
    slices = placed.groupBy(*LEVELS, F.expr("substring(slice, 1, (length(slice) + 1) div 2)").alias("block"), "slice").agg(F.sum("sum").alias("slice_tokens"))
    earlier = lambda by, order: F.coalesce(F.sum("slice_tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = slices.groupBy(*LEVELS, "block").agg(F.sum("slice_tokens").alias("slice_tokens")).withColumn("before_block", earlier(LEVELS, "block")).drop("slice_tokens")
    slices = slices.withColumn("before_slice", earlier((*LEVELS, "block"), "slice")).join(blocks, [*LEVELS, "block"])
    slices = slices.select(*LEVELS, "slice", (F.col("before_slice") + F.col("before_block")).alias("before_slice"))
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("key", "doc_id", "tokens", *more).rowsBetween(Window.unboundedPreceding, -1)
    x = placed.join(slices, [*LEVELS, "slice"]).withColumn("before", F.col("before_slice") + F.coalesce(F.sum("sum").over(inside), F.lit(0)))
    # Of n rows side by side those that begin before the prefix ends are taken; where it ends within one, that one in part.
    left = F.greatest(F.col("rest") - F.col("before"), F.lit(0))
    x = x.withColumn("n_full", F.when(F.col("tokens") > 0, F.least(F.col("n"), F.expr("greatest(rest - before, 0) div greatest(tokens, 1)"))).otherwise(F.when(left > 0, F.col("n")).otherwise(0)))
    x = x.withColumn("part", F.when((F.col("n_full") < F.col("n")) & (F.col("tokens") > 0), left - F.col("n_full") * F.col("tokens")).otherwise(0))
    return x.select("doc_id", *LEVELS, "tokens", *more, "n", "whole", F.col("n_full").cast("long").alias("n_full"), F.col("part").cast("long").alias("part"))


def mix_plan(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """One row per document and pass that takes it: ``doc_id, domain, language, origin, epoch, tokens, tokens_used``.

    Null languages and sources are a node named by the empty string. A text without words, or null, costs nothing and
    is taken in whole passes and wherever the prefix of the last one has tokens left before it. A row that repeats a
    doc_id counts as a document of its own and, with an equal order key, stands beside the other. A leaf without tokens
    gets no budget and gives no rows. An empty table gives no rows. ``tokens_used`` is less than ``tokens`` only for the
    document at the end of a leaf's prefix.
    """
    passes = F.expr(
        "concat(transform(array_remove(sequence(0L, whole), whole), e -> named_struct('epoch', e, 'used', tokens, 'copies', n)),"
        " array(named_struct('epoch', whole, 'used', tokens, 'copies', n_full), named_struct('epoch', whole, 'used', part, 'copies', CAST(part > 0 AS BIGINT))))"
    )
    x = _drawn(docs, mix).select("doc_id", *LEVELS, "tokens", F.explode(passes).alias("p"))
    x = x.select("doc_id", *LEVELS, F.col("p.epoch").cast("int").alias("epoch"), "tokens", F.col("p.used").alias("tokens_used"), F.col("p.copies").alias("mix_copies"))
    return repeated(x, "mix_copies").drop("mix_copies", "mix_i")


def token_prefix(text: F.Column, n: F.Column) -> F.Column:
    """The text up to the end of its ``n``-th word and the blanks behind it."""
    pieces = F.split(text, r"(?<=[ \t\n\r])(?=[^ \t\n\r])", -1)
    lead = text.rlike(r"^[ \t\n\r]").cast("int")
    return F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), "")


def mix_documents(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Rows of ``docs``, once for each pass that takes them; where a leaf's prefix ends within a text, that row has the text up
    to there (and ``n_chars``, if there is such a column, its length).

    Rows that repeat a leaf, doc_id and text are drawn as often as all of them together, as copies of one of them. Rows with a
    null doc_id or of no tokens follow their leaf. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    drawn = _drawn(docs, mix, F.xxhash64(text).alias("mix_hash")).withColumn("mix_times", F.col("whole") * F.col("n") + F.col("n_full")).where("mix_times > 0 or part > 0")
    k = cut(drawn.select(F.struct(*LEVELS, "doc_id", "mix_hash").alias("mix_id"), "mix_times", F.col("part").alias("mix_part")))
    row = docs.select(F.struct("*").alias("mix_row"), F.struct(*_leaf(mix), "doc_id", F.xxhash64(text).alias("mix_hash")).alias("mix_id"))
    # Of rows alike one is chosen by an aggregate that mappers begin, before anything is joined; texts are shuffled once.
    plain = [F.col(f"mix_row.`{f.name}`") for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = row.groupBy("mix_id").agg(F.min_by("mix_row", F.xxhash64(*plain)).alias("mix_row"))
    got = one.join(k, "mix_id").select("mix_row", "mix_times", "mix_part")
    whole = repeated(got, "mix_times").select("mix_row.*")
    # Columns are taken out of the row one by one: the documents may have columns named like those beside it.
    short = token_prefix(F.col("mix_row.text").cast("string"), F.col("mix_part"))
    changed = {"text": short}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(short).cast(docs.schema["n_chars"].dataType)
    cut_off = got.where("mix_part > 0").select(*[changed.get(c, F.col(f"mix_row.`{c}`")).alias(c) for c in docs.columns])
    return whole.unionByName(cut_off)


#: The plan for ``MIX`` in DuckDB SQL.
_LEVEL_SQL = """
n{i} AS (SELECT {keys}, sum(supply)::BIGINT AS supply, any_value({w}) AS w FROM leaves GROUP BY {keys}),
o{i} AS (SELECT n.*, g.budget, supply / w AS ratio FROM n{i} n {join}),
p{i} AS (SELECT *, coalesce(sum(supply) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM o{i} WINDOW u AS (PARTITION BY {parents} ORDER BY ratio, {level})),
q{i} AS (SELECT *, supply::HUGEINT * rest_w <= w::HUGEINT * greatest(budget - used, 0) AS isfull FROM p{i}),
r{i} AS (SELECT *, greatest(budget - coalesce(sum(CASE WHEN isfull THEN supply END) OVER (PARTITION BY {parents}), 0), 0) AS lft,
                sum(CASE WHEN isfull THEN 0 ELSE w END) OVER (PARTITION BY {parents}) AS open_w,
                sum(CASE WHEN isfull THEN 0 ELSE w END) OVER (PARTITION BY {parents} ORDER BY ratio, {level} ROWS UNBOUNDED PRECEDING) AS cum_w FROM q{i}),
g{i} AS (SELECT {keys}, (CASE WHEN isfull THEN supply ELSE least(supply, (cum_w::HUGEINT * lft) // open_w - ((cum_w - w)::HUGEINT * lft) // open_w) END)::BIGINT AS budget FROM r{i})"""


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END" if weights else "1"


def plan_sql(mix: Mix = MIX) -> str:
    """``mix_plan`` in DuckDB SQL; the domain rule needs crc32, so it is given as a table of sources by ``domain_values``."""
    import zlib

    names = ", ".join(f"('src{i}', 'domain{zlib.crc32(f'src{i}'.encode()) % 4}')" for i in range(200))
    parts, keys = [], []
    for i, (level, w) in enumerate(zip(LEVELS, (mix.domains, mix.languages, mix.origins), strict=True)):
        parents = list(keys)
        keys.append(level)
        parts.append(_LEVEL_SQL.format(i=i, keys=", ".join(keys), level=level, w=_case(level, w), parents=", ".join(parents) or "1", join=f"JOIN g{i - 1} g USING ({', '.join(parents)})" if parents else "CROSS JOIN total g"))
    return f"""
WITH names(source, domain) AS (VALUES {names}),
d AS (SELECT doc_id, domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS tokens
      FROM documents LEFT JOIN names USING (source)),
leaves AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {mix.max_epochs})::BIGINT AS supply FROM d GROUP BY ALL HAVING sum(tokens) > 0),
total AS (SELECT coalesce(floor(sum(tokens) * {mix.budget_milli} / 1000), 0)::BIGINT AS budget FROM leaves),{','.join(parts)},
plan AS (SELECT domain, language, origin, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN g2 USING (domain, language, origin)),
x AS (SELECT *, md5(concat_ws('|', '{mix.seed}', whole::VARCHAR, doc_id::VARCHAR)) AS key FROM d JOIN plan USING (domain, language, origin)),
y AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
z AS (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM y)
SELECT doc_id, domain, language, origin, epoch::INTEGER AS epoch, tokens,
       (CASE WHEN epoch < whole THEN tokens ELSE least(tokens, rest - before) END)::BIGINT AS tokens_used
FROM z WHERE epoch < whole OR before < rest
"""
