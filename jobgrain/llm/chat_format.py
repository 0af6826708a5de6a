"""Preference formatting: the longest common turn prefix once as prompt, then chosen and rejected completions.

The two conversations of a pair are compared turn by turn. All turns before the first difference (other role or
text, or a turn that one side lacks) are the prompt, rendered once and never trained on; the rest of each side is its
completion, in which the assistant's messages are trained on and all others masked. The result has one row for each
message, so the comparison never gathers a conversation in one task; ``assemble`` joins the rows of a pair into the strings
and trained spans of one training example. Markers of turns inside roles and texts are broken up, so that no text can
open or close a turn. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import require

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(c: Column) -> Column:
    """Without the beginning of a marker."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit("\n"), escaped(text), F.lit(CLOSE))


def preference_messages(chosen: DataFrame, rejected: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Two tables (pair_id, turn, role, text) -> pair_id, part, turn, seq, role, rendered, trained.

    part is prompt, chosen or rejected; a side that ends first has no rows of its own. Pairs with one side only, and rows
    with a null pair_id, have no result. Rows of one side that share a turn number stand in the order of (role, text),
    numbered by seq, repeats included; a null turn comes before all others; null roles and texts count as empty. Empty
    tables give an empty result; further columns are ignored.
    """
    side = lambda df, name: require(df, "pair_id", "turn", "role", "text").select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.lit(name).alias("side"),
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"),
    )
    both = side(chosen, "chosen").unionByName(side(rejected, "rejected")).where("pair_id is not null")
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("m"))))
    turns = both.groupBy("pair_id", "turn").agg(pick("chosen").alias("chosen"), pick("rejected").alias("rejected"))
    differs = F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))
    ends = turns.groupBy("pair_id").agg(
        F.min(differs).alias("fork"), F.max(F.size("chosen")).alias("_c"), F.max(F.size("rejected")).alias("_r")
    ).where("_c > 0 and _r > 0")
    forked = turns.join(ends.select("pair_id", "fork"), "pair_id")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("ms")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("ms")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("ms")))
    )
    rows = forked.select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "turn", "p.part", F.posexplode("p.ms").alias("seq", "m"))
    return rows.select(
        "pair_id", "part", F.when(F.col("turn") != -(1 << 63), F.col("turn")).alias("turn"), "seq", F.col("m.role").alias("role"),
        render(F.col("m.role"), F.col("m.text")).alias("rendered"),
        ((F.col("part") != "prompt") & F.col("m.role").isin(*trained_roles)).alias("trained"),
    )


def pair_neighbours(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as the pairs k."""
    rows = require(conversations, "conv_id", "turn", "role", "text").withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    return tuple(rows.where(F.pmod("conv_id", F.lit(2)) == k).drop("conv_id") for k in (0, 1))


def last_reply_pairs(conversations: DataFrame, reply: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """A pair for each conversation, named by its conv_id: chosen is the conversation; rejected is the same up to its last reply, with the last reply of
    its neighbour (2k + 1 for 2k, 2k for 2k + 1) in that one's place, or with none there if the neighbour has no reply.

    Conversations without a reply make no pair, nor do those that consist of one reply alone and have no neighbour with one; rows with a null
    conv_id or turn are left out.
    """
    rows = require(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null").withColumn("conv_id", F.col("conv_id").cast("long"))
    ends = rows.where(F.col("role") == reply).groupBy(F.col("conv_id").alias("pair_id")).agg(F.max("turn").alias("fork"))
    columns = ["pair_id", "turn", "role", "text"]
    chosen = rows.withColumnRenamed("conv_id", "pair_id").join(ends, "pair_id")
    last = chosen.where((F.col("turn") == F.col("fork")) & (F.col("role") == reply)).select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), "role", "text")
    swapped = last.join(ends, "pair_id").select("pair_id", F.col("fork").alias("turn"), "role", "text")
    return chosen.select(columns), chosen.where("turn < fork").select(columns).union(swapped)


def assemble(messages: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, and the trained spans [start, end) in characters of both completions.

    Gathers the messages of a pair, which are one training example and one row of the result.
    """
    item = F.struct("turn", "seq", "rendered", "trained")
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, item)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["rendered"]), "")

    def spans(c: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + F.length(x["rendered"])).alias("at"),
            F.when(x["trained"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["rendered"])).alias("end"))))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(c, start, step, lambda acc: acc["out"])

    sides = messages.groupBy("pair_id").agg(of("prompt").alias("p"), of("chosen").alias("c"), of("rejected").alias("r"))
    return sides.select(
        "pair_id", text(F.col("p")).alias("prompt"), text(F.col("c")).alias("chosen"), text(F.col("r")).alias("rejected"),
        spans("c").alias("chosen_trained"), spans("r").alias("rejected_trained"),
    )


def written_spans(spans: Column) -> Column:
    """As text: start-end, comma-separated; null if there are none."""
    return F.nullif(F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["end"])), ","), F.lit(""))


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
e AS (SELECT conv_id, max(turn) AS fork FROM c WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT * FROM c JOIN e USING (conv_id)),
m1 AS (SELECT conv_id AS pair_id, 'c' AS side, turn, role, text FROM p UNION ALL SELECT conv_id, 'r', turn, role, text FROM p WHERE turn < fork
       UNION ALL SELECT e.conv_id, 'r', e.fork, role, text FROM p JOIN e ON e.conv_id = xor(p.conv_id, 1) WHERE turn = p.fork AND role = 'assistant'),
m0 AS (SELECT * FROM m1 WHERE pair_id IN (SELECT pair_id FROM m1 WHERE side = 'r')),
m AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) AS seq FROM m0),
f AS (SELECT pair_id, min(turn) AS fork FROM (
        SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn FROM (SELECT * FROM m WHERE side = 'c') c FULL JOIN (SELECT * FROM m WHERE side = 'r') r
        ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.seq = r.seq AND c.role = r.role AND c.text = r.text
        WHERE c.pair_id IS NULL OR r.pair_id IS NULL) GROUP BY 1),
x AS (SELECT m.pair_id, turn, seq, side, role, fork IS NULL OR turn < fork AS shared, role = 'assistant' AS trained,
             '{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS t FROM m LEFT JOIN f USING (pair_id)),
s AS (SELECT *, sum(length(t)) OVER (PARTITION BY pair_id, side ORDER BY turn, seq) AS stop FROM x WHERE NOT shared)
SELECT pair_id, coalesce(string_agg(t, '' ORDER BY turn, seq) FILTER (shared AND side = 'c'), '') AS prompt,
  coalesce(string_agg(t, '' ORDER BY turn, seq) FILTER (NOT shared AND side = 'c'), '') AS chosen, coalesce(string_agg(t, '' ORDER BY turn, seq) FILTER (NOT shared AND side = 'r'), '') AS rejected,
  any_value(cs) AS chosen_trained, any_value(rs) AS rejected_trained
FROM x LEFT JOIN (SELECT pair_id, string_agg((stop - length(t)) || '-' || stop, ',' ORDER BY turn, seq) FILTER (trained AND side = 'c') AS cs,
                         string_agg((stop - length(t)) || '-' || stop, ',' ORDER BY turn, seq) FILTER (trained AND side = 'r') AS rs FROM s GROUP BY 1) USING (pair_id)
GROUP BY pair_id
"""
