"""Chat formatting: reply trees, ranked branches and one formatted conversation per chosen path, with DataFrame functions only.

Messages point at the message they answer. Self-joins double the distance that a pointer spans, so a tree of depth d takes
log2(d) rounds: they give each message its root, its depth and the score of its path. The leaves of a tree are its
branches; the best are chosen, and the pointers, from the longest to the shortest, mark the messages above each chosen leaf.

Template: a turn is `### role: text</turn>` and a newline. In roles and texts backslash, <, # and, in roles, the colon stand
as `\\\\`, `\\l`, `\\h` and `\\c`, so no text can hold a control string, and reading back is exact.

Nulls: text and role are empty, a null conversation is a conversation, a null score 0, a message whose parent is missing
is a root. Of messages that answer each other in a circle, or of one that answers itself, the one with the smallest id is a
root. Ties: smaller message ids come first. Of several rows with one id in a conversation the least by parent, score, role
and text stands (in plain conversations, which have no ids, repeated rows are messages of their own); rows with a null id
are left out. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, AFTER_ROLE, END = "### ", ": ", "</turn>\n"


def escaped(x: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(x: Column) -> Column:
    """Pairs of backslashes are found from the left, so what is between them has single ones only."""

    def part(p: Column) -> Column:
        return F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), part), "\\")


def chains(messages: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Plain conversations as trees: each row answers the one before it. Columns conv_id, id, parent, role, text, score."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(order).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.row_number().over(w).cast("long"))
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def once(messages: DataFrame) -> DataFrame:
    """One row for each id of a conversation; null scores, roles and texts are filled."""
    fields = F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return messages.where(F.col("id").isNotNull()).groupBy("conv_id", "id").agg(F.min(fields).alias("m")).select("conv_id", "id", "m.*")


def _circle_roots(pointers: DataFrame, rounds: int) -> DataFrame:
    """c2, i2: the smallest id of each circle. After 2^rounds steps, more than a conversation has messages, only walks in a
    circle go on, and they stand on each of its messages; the smallest id that a walk from one of these meets is the circle's."""
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("i2"))
    now = pointers.where(F.col("up").isNotNull()).select("conv_id", "id", "up", F.col("id").alias("least"))
    for _ in range(rounds):
        above = now.select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), F.col("up").alias("u2"), F.col("least").alias("l2"))
        now = staged(now.join(above, same).select("conv_id", "id", F.col("u2").alias("up"), F.least("least", "l2").alias("least")), "circles")
    reached = now.select(F.col("conv_id").alias("c2"), F.col("up").alias("i2")).distinct()
    return now.where(F.col("least") == F.col("id")).join(reached, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2"))).select("c2", "i2")


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, root, branch (1: the best), depth (from 0), id: the messages of the chosen branches of each tree.

    messages: conv_id, id, parent and score, as once() leaves them. A branch's score is the sum along its path."""
    nodes = staged(messages.where(F.col("id").isNotNull()).select("conv_id", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).head()[0] or 0
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    known = nodes.select(F.col("conv_id").alias("c2"), F.col("id").alias("p2"))
    start = nodes.join(known, same("conv_id", "c2") & (F.col("parent") == F.col("p2")), "left").select("conv_id", "id", F.col("p2").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("span"), F.col("id").alias("top"))
    now = staged(start, "pointers")
    levels = [now]
    while not (active := now.where(F.col("up").isNotNull())).isEmpty():
        if len(levels) > largest.bit_length():  # the pointers span more than there are messages: circles
            cut = staged(_circle_roots(levels[0], largest.bit_length()), "circle-roots")
            open_ = nodes.join(cut, same("conv_id", "c2") & (F.col("id") == F.col("i2")), "left")
            return chosen_paths(open_.withColumn("parent", F.when(F.col("i2").isNull(), F.col("parent"))), branches)
        above = now.select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), F.col("up").alias("u2"), F.col("total").alias("t2"), F.col("span").alias("s2"), F.col("top").alias("top2"))
        further = active.join(above, same("conv_id", "c2") & (F.col("up") == F.col("i2"))).select("conv_id", "id", F.col("u2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("span") + F.col("s2")).alias("span"), F.col("top2").alias("top"))
        now = staged(further.unionByName(now.where(F.col("up").isNull())), "pointers")
        levels.append(now)
    parents = levels[0].where(F.col("up").isNotNull()).select(F.col("conv_id").alias("c2"), F.col("up").alias("p2")).distinct()
    leaves = now.join(parents, same("conv_id", "c2") & (F.col("id") == F.col("p2")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id", "top").orderBy(F.desc("total"), "id"))
    best = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    marked = staged(best.select("conv_id", F.col("top").alias("root"), "branch", "id"), "marked")
    for level in reversed(levels[:-1]):  # each message of a path is reached by one sum of powers of two
        up = level.where(F.col("up").isNotNull()).select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), "up")
        marked = staged(marked.unionByName(marked.join(up, same("conv_id", "c2") & (F.col("id") == F.col("i2"))).select("conv_id", "root", "branch", F.col("up").alias("id"))), "marked")
    depth = now.select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), (F.col("span") - 1).alias("depth"))
    return marked.join(depth, same("conv_id", "c2") & (F.col("id") == F.col("i2"))).select("conv_id", "root", "branch", "depth", "id")


def formatted(messages: DataFrame, branches: int = 1, learned: str = "assistant", unique: bool = False) -> DataFrame:
    """conv_id, root, branch, n_turns, formatted, loss (spans of code points: start, length): a row for each chosen branch.

    messages: conv_id, id, parent, role, text, score; unique: as once() leaves them, so they needn't be grouped by id. The
    mask covers the escaped texts of the learned role, without the template around them."""
    messages = messages if unique else staged(once(messages), "messages")
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2"))
    texts = messages.select(F.col("conv_id").alias("c2"), F.col("id").alias("i2"), "role", "text")
    rows = chosen_paths(messages, branches).join(texts, same)
    head = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit(AFTER_ROLE))
    turn = F.struct("depth", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learned).alias("learn"))
    paths = rows.groupBy("conv_id", "root", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    none = F.array().cast("array<struct<start:long,length:long>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        size = F.length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return paths.select("conv_id", "root", "branch", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), loss.alias("loss"))


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of structs of role and text."""
    parts = F.split(text, END, -1)
    turns = F.filter(parts, lambda x, i: i < F.size(parts) - 1)  # nothing follows the last end

    def turn(x: Column) -> Column:
        at = F.instr(x, AFTER_ROLE)
        return F.struct(unescaped(F.substring(x, len(START) + 1, at - len(START) - 1)).alias("role"), unescaped(F.substring(x, at + len(AFTER_ROLE), F.length(x))).alias("text"))

    return F.transform(turns, turn)


def masked(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, on end."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What each formatted conversation of chains() says when it is read back."""
    done = staged(formatted(conversations, unique=True), "formatted")
    read = done.select("conv_id", parsed(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("under"), F.length("formatted").alias("size"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.col("size").cast("long").alias("formatted_chars"))
