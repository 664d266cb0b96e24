"""Chat formatting: multi-party perspective rotation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What markers begin with, and what stands for it in texts and names, so that no turn can render as another.
MARK, NEUTRAL = "<|im_", "< |im_"


def perspectives(turns: DataFrame, page: int = 256, neutral: tuple[str, ...] = ("system",)) -> DataFrame:
    """Each dialogue as each of its participants sees it: that speaker as assistant, the others as named users.

    turns: conv_id long, turn long, role string (the speaker), text string; other columns are ignored. Speakers in
    `neutral` take no part and are rendered under their own name for everyone. A dialogue is rendered in pages of `page`
    turn numbers (turn div page), so no row grows with a dialogue's length; a page's text continues the page before.

    Returns conv_id, participant, page, n_turns, n_target_turns, text and mask: the [from, to) character spans of text
    that the participant says, as from-to joined by commas (the loss is on these). Markers inside texts and names are made
    harmless (MARK becomes NEUTRAL). Turns are ordered by turn, then role
    (null first), then text, so ties and repeated rows have one result. A null role is the speaker "unknown", a null text
    the empty one, a null turn is before all others in page -1, null ids form one dialogue. A dialogue of neutral
    speakers alone, and an empty table, give no rows.
    """
    speaker = F.coalesce("role", F.lit("unknown"))
    rows = turns.select("conv_id", F.coalesce(F.floor(F.col("turn") / page), F.lit(-1)).cast("long").alias("page"), F.struct("turn", speaker.alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(NEUTRAL)).alias("text")).alias("t"))
    people = rows.where(~F.col("t.role").isin(*neutral)).select("conv_id", F.col("t.role").alias("participant")).distinct().select(F.col("conv_id").alias("_c"), "participant")
    pages = rows.groupBy("conv_id", "page").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    seen = pages.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def rendered(t: Column) -> Column:
        own = t["role"] == F.col("participant")
        name = F.when(own, F.lit("assistant")).when(t["role"].isin(*neutral), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))
        head = F.concat(F.lit(OPEN), F.replace(name, F.lit(MARK), F.lit(NEUTRAL)), F.lit("\n"))
        return F.struct(own.alias("own"), F.char_length(head).alias("head"), F.char_length(t["text"]).alias("body"), F.concat(head, t["text"], F.lit(CLOSE)).alias("text"))

    seen = seen.select("conv_id", "participant", "page", F.transform("turns", rendered).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + p["head"]
        span = F.concat_ws("-", begin.cast("string"), (begin + p["body"]).cast("string"))
        return F.struct((begin + p["body"] + len(CLOSE)).cast("long").alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    mask = F.aggregate("parts", start, step, lambda a: F.concat_ws(",", a["spans"]))
    return seen.select(
        "conv_id",
        "participant",
        "page",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_target_turns"),
        F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("text"),
        mask.alias("mask"),
    )
