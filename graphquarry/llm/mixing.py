"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Token weights are summed into cells of (source, language, topic). Raking scales the cells until the shares of each margin
meet their targets: a step is a window over the cells of one margin value. Cells are counted; up to MOST_CELLS they stand
in one partition, so that a block of rounds is one task without exchanges; more cells are dealt by the margin of each step.
Blocks of rounds go on until the largest residual is within a tolerance. Each document is then kept with its cell's
calibrated probability, by a uniform number that is a hash of its id: the same documents are kept however the job is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, if_small, materialise, text_or_empty

#: Rounds of a block; blocks go on until the shares are within TOLERANCE of their targets, MOST_BLOCKS at most: margins that
#: contradict one another never meet, and the residual then says so.
ITERATIONS, TOLERANCE, MOST_BLOCKS = 8, 1e-7, 25
#: Cells that one task rakes, and cells that are broadcast to the documents (a row of three short names and a number).
MOST_CELLS, BROADCAST_CELLS = 1_000_000, 100_000
SALTS = 64
MARGINS = ("source", "lang", "topic")
#: Exponents below 1 move the shares of a margin toward equal ones.
TEMPERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Decimal places of the probabilities.
PLACES = 9


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds."""
    t = text_or_empty(text)
    return (
        F.when(t.rlike("(?i)licen[sc]ed? under|released under the"), "licence")
        .when(t.contains(" | "), "table")
        .when(t.rlike(r"[0-9]+@|token = "), "contact")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.ceil(F.length(text_or_empty(text)) / 4), F.lit(1)).cast("double")


def cells(docs: DataFrame) -> DataFrame:
    """source, lang, topic, tokens. Documents have these columns; null is a value of its own."""
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))


def number(rows: DataFrame, of: Column) -> float:
    """One number over all rows; 0 if there are none."""
    return float(rows.agg(of.alias("n")).first()["n"] or 0.0)


def tempered(table: DataFrame, tempers: dict[str, float]) -> DataFrame:
    """margin, value, target: the present shares of each margin to a power, made to sum to one."""
    out = None
    for m, power in tempers.items():
        sums = table.groupBy(F.col(m).cast("string").alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("r"))
        rows = sums.select(F.lit(m).alias("margin"), "value", (F.col("r") / F.lit(number(sums, F.sum("r")))).alias("target"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_targets(table: DataFrame, targets: DataFrame) -> DataFrame:
    """The cells with a column of target shares for each margin: 0 where a value has none."""
    for m in MARGINS:
        own = targets.where(F.col("margin") == m).select(F.col("value").alias("_value"), F.col("target").alias(f"target_{m}"))
        table = table.join(own, F.col(m).cast("string").eqNullSafe(F.col("_value")), "left").drop("_value")
        table = table.withColumn(f"target_{m}", F.coalesce(f"target_{m}", F.lit(0.0)))
    return table


def rounds(table: DataFrame, n: int, few: bool = True) -> DataFrame:
    """`weight` after n rounds of raking; a margin's cells without weight keep none. Few cells stand in one task, and a step
    is a window there. Many cells aren't put together: the sums of a margin's values are joined to them, each step is
    written, and a value that holds most cells is summed by parts."""
    for _ in range(n):
        for m in MARGINS:
            if few:
                have = F.sum("weight").over(Window.partitionBy(m))
            else:
                sums = table.groupBy(F.col(m).alias("_value")).agg(F.sum("weight").alias("_have"))
                table = table.join(if_small(materialise(sums, "mix-sums")), F.col(m).eqNullSafe(F.col("_value")), "left")
                have = F.col("_have")
            table = table.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"target_{m}") * F.col("total") / have).otherwise(0.0))
            table = table if few else materialise(table.drop("_value", "_have"), "mix-step")
    return table


def residual(raked: DataFrame) -> float:
    """The largest distance of a margin value's share from its target."""
    some, off = raked.where("total > 0"), [0.0]
    for m in MARGINS:
        shares = some.groupBy(m).agg((F.sum("weight") / F.first("total")).alias("share"), F.first(f"target_{m}").alias("target"))
        off.append(number(shares, F.max(F.abs(F.col("share") - F.col("target")))))
    return max(off)


def rake(table: DataFrame, targets: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, float]:
    """The cells with `weight`, token weights that meet the targets (margin, value, target: shares) of all margins, and the
    largest residual. Cells whose value has no target get weight 0. The weights sum to the tokens that there are."""
    few = table.count() <= MOST_CELLS
    table = with_targets(table, targets)
    table = table.coalesce(1) if few else table
    table = table.withColumn("total", F.lit(number(table, F.sum("tokens")))).withColumn("weight", F.col("tokens"))
    for _ in range(most_blocks):
        table = materialise(rounds(table, iterations, few), "mix-raked")
        table = table.coalesce(1) if few else table
        off = residual(table)
        if off <= tolerance:
            break
    return table.select(*MARGINS, "tokens", "weight"), off


def probabilities(raked: DataFrame) -> DataFrame:
    """source, lang, topic, probability: in proportion to weight over tokens, the largest is 1. So the expected tokens of
    the sample have exactly the raked shares."""
    rate = raked.select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("rate"))
    top = number(rate, F.max("rate"))
    share = F.round(F.col("rate") / F.lit(top), PLACES) if top > 0 else F.lit(0.0)
    return rate.select(*MARGINS, share.alias("probability"))


def with_chances(rows: DataFrame, chance: DataFrame) -> DataFrame:
    """Each row's probability by its cell. Few cells are broadcast; many are joined by a salted key, so that a cell that
    holds a third of the rows is dealt to SALTS tasks."""
    if chance.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        chance, salt = F.broadcast(chance), F.lit(True)
    else:
        chance = chance.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(rows["doc_id"]), F.lit(SALTS)).cast("int") == chance["salt"]
    on = [rows[m].eqNullSafe(chance[m]) for m in MARGINS]
    return rows.join(chance, [*on, salt]).select("doc_id", *(rows[m] for m in MARGINS), "tokens", "probability")


def uniform(id_col: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the id; a null id counts as the empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: Column | None = None, lang: Column | None = None, topic: Column | None = None, targets: DataFrame | None = None, tempers: dict[str, float] | None = None, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept, residual (the largest distance of a margin's share from its target).

    `targets` (margin, value, target) are the wanted shares; without them the present ones to the powers `tempers`. One row
    per row of the table; other columns are ignored. A null source or language is a value of its own; a null text has one
    token. Rows that repeat an id share its fate; rows without an id are sampled as one. An empty table gives an empty
    result. Targets that contradict one another (margins that determine each other) can't all be met: the last margin is
    then met, and `residual` says how far another one is off.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col("source") if source is None else source).alias("source"),
        (F.col("lang") if lang is None else lang).alias("lang"),
        (topic_of(F.col(text_col)) if topic is None else topic).alias("topic"),
        tokens_of(F.col(text_col)).alias("tokens"),
    )
    rows = materialise(rows, "mix-rows")
    table = materialise(cells(rows), "mix-cells")
    raked, off = rake(table, targets if targets is not None else tempered(table, tempers or TEMPERS), iterations, tolerance)
    out = with_chances(rows, materialise(probabilities(raked), "mix-chances"))
    return out.withColumn("kept", uniform(F.col("doc_id")) < F.col("probability")).withColumn("residual", F.lit(off))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled documents, with their own columns."""
    of = fresh(docs, "_dropped")
    dropped = mix_sources(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(of)).distinct()
    dropped = if_small(materialise(dropped, "mix-dropped"))
    return docs.join(dropped, docs[id_col].eqNullSafe(F.col(of)), "left_anti").select(*docs.columns)


def sql(iterations: int = ITERATIONS) -> str:
    """The same in DuckDB's SQL, one common table for each step of the raking."""
    steps = [
        r"""d AS (
  SELECT doc_id, source, lang,
         CASE WHEN regexp_matches(coalesce(text, ''), '(?i)licen[sc]ed? under|released under the') THEN 'licence'
              WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
              WHEN regexp_matches(coalesce(text, ''), '[0-9]+@|token = ') THEN 'contact' ELSE 'prose' END AS topic,
         greatest(ceil(length(coalesce(text, '')) / 4.0), 1)::DOUBLE AS tokens
  FROM documents
)""",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
        "w0 AS (SELECT *, tokens AS weight FROM c)",
    ]
    for m in MARGINS:
        steps.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens), {TEMPERS[m]}) / (SELECT sum(r) FROM (SELECT pow(sum(tokens), {TEMPERS[m]}) AS r FROM c GROUP BY {m})) AS target FROM c GROUP BY {m})")
    k = 0
    for _ in range(iterations):
        for m in MARGINS:
            k += 1
            steps.append(
                f"w{k} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * t.target * (SELECT sum(tokens) FROM c) / sum(w.weight) OVER (PARTITION BY w.{m}) AS weight"
                f" FROM w{k - 1} w JOIN t_{m} t ON t.{m} IS NOT DISTINCT FROM w.{m})"
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
p AS (SELECT source, lang, topic, round(weight / tokens / (SELECT max(weight / tokens) FROM w{k}), {PLACES}) AS probability FROM w{k})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, p.probability,
       ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p.probability AS kept
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.lang IS NOT DISTINCT FROM d.lang AND p.topic = d.topic"""
    )
