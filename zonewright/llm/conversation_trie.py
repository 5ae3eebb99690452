"""Prefix trie of conversations: a Cartesian tree over the common prefixes of neighbours in sorted order."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import number_rows

#: A conversation c begins with the first turns of c - c % FAMILY, at most MOST_SHARED - 1 of them.
FAMILY, MOST_SHARED = 100, 6
#: So many turns of a conversation stand in one row: a chunk. Sorted chunks are the letters of a conversation's word.
CHUNK = 256
#: So many values (common prefixes, or minima of blocks) are searched together in one task.
BLOCK = 4096
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def turn_mark(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn (role, text) from any other; nulls count as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, mark, chars) of every turn, at from 1, stored; and (conv_id, n_own), a row for each conversation.

    Turns are ranged by (conv_id, turn, ...), so a long conversation lies in many tasks, and numbered by offsets.
    """
    c = conversations.filter(F.col("conv_id").isNotNull())
    chars = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    bare = c.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_mark(F.col("role"), F.col("text")).alias("mark"), chars.alias("chars"))
    rows = number_rows(bare, ["conv_id", "turn", "role", "mark"], "trie-turns")  # ascending puts null first
    first = rows.groupBy("conv_id").agg(F.min("position").alias("first"), F.count("*").alias("n_own"))
    first = materialize(first, "trie-conversations")
    turns = rows.join(first.select("conv_id", "first"), "conv_id").select("conv_id", (F.col("position") - F.col("first") + 1).alias("at"), "mark", "chars")
    return materialize(turns, "trie-numbered"), first.select("conv_id", "n_own")


def rebuilt_turns(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, at, mark, chars) of the rebuilt conversations: shared first turns of the family's head, then their own later ones."""
    c = F.col("conv_id")
    shared = (F.crc32(c.cast("string")) % MOST_SHARED).cast("long")
    head = turns.filter((c % FAMILY == 0) & (F.col("at") < MOST_SHARED)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "mark", "chars"))).alias("head"))
    plan = conversations.select("conv_id", shared.alias("shared"), (c - c % FAMILY).alias("of")).join(head.withColumnRenamed("conv_id", "of"), "of", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(head.schema["head"].dataType)), 1, F.col("shared").cast("int"))
    plan = materialize(plan.select("conv_id", "shared", taken.alias("taken")), "trie-plan")
    front = plan.select("conv_id", F.inline("taken"))
    own = turns.join(plan.select("conv_id", "shared", F.size("taken").alias("before")), "conv_id").filter("at > shared")
    return front.unionByName(own.select("conv_id", (F.col("at") - F.col("shared") + F.col("before")).alias("at"), "mark", "chars"))


def chunked(turns: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, marks, upto): the turns in rows of at most `chunk`, with their characters summed from the row's first on."""
    number = F.expr(f"(at - 1) div {chunk}")
    held = turns.groupBy("conv_id", number.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "mark", "chars"))).alias("t"))
    chars = F.transform("t", lambda x: x["chars"])
    sums = F.aggregate(chars, F.array().cast("array<long>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))))
    return held.select("conv_id", "chunk", F.transform("t", lambda x: x["mark"]).alias("marks"), sums.alias("upto"))


def common(a: Column, b: Column) -> Column:
    """How many first entries of two arrays are the same."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~F.coalesce(x == y, F.lit(False))), True)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("long")


def _in_order(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    i = t["i"].to_numpy()
    order = np.argsort(i)
    return i[order], t["v"].to_numpy()[order]


def _smaller_in_block(values: pa.Table) -> pa.Table:
    """(i, v, before, after): the nearest places of smaller values on both sides within a block; null where there is none."""
    i, v = (x.tolist() for x in _in_order(values))
    before, after, rising = [None] * len(i), [None] * len(i), []
    for k, value in enumerate(v):
        while rising and v[rising[-1]] > value:
            after[rising.pop()] = i[k]
        if rising:
            last = rising[-1]
            before[k] = before[last] if v[last] == value else i[last]
        rising.append(k)
    return pa.table([pa.array(x, pa.int64()) for x in (i, v, before, after)], names=["i", "v", "before", "after"])


def _smaller_beyond(asked: pa.Table, values: pa.Table) -> pa.Table:
    """asked (i, v, side) with the nearest place beyond i on its side (-1, 1) that holds less than v; null where there is none."""
    i, v = _in_order(values)
    found = []
    for at, limit, side in zip(asked["i"].to_pylist(), asked["v"].to_pylist(), asked["side"].to_pylist()):
        cut = np.searchsorted(i, at, "right" if side > 0 else "left")
        less = np.flatnonzero(v[cut:] < limit) + cut if side > 0 else np.flatnonzero(v[:cut] < limit)
        found.append(int(i[less[0 if side > 0 else -1]]) if len(less) else None)
    return pa.table([asked["i"], asked["v"], asked["side"], pa.array(found, pa.int64())], names=["i", "v", "side", "found"])


def _smaller_within(asked: pa.Table, values: pa.Table) -> pa.Table:
    """asked (i, v, side, found): the place in block `found` nearest to its edge on i's side that holds less than v."""
    at, v = _in_order(values)
    place = []
    for limit, side in zip(asked["v"].to_pylist(), asked["side"].to_pylist()):
        less = np.flatnonzero(v < limit)
        place.append(int(at[less[0 if side > 0 else -1]]))
    return pa.table([asked["i"], asked["v"], asked["side"], pa.array(place, pa.int64())], names=["i", "v", "side", "place"])


def _minima(values: DataFrame, block: int) -> DataFrame:
    return materialize(values.groupBy(F.expr(f"i div {block}").alias("i")).agg(F.min("v").alias("v")), "trie-minima")


def _with_blocks(asked: DataFrame, values: DataFrame, block: int, of: str, look, kind: str) -> DataFrame:
    """look(asked, values) for each block of values; asked name theirs by column `of`."""
    left = asked.select("*", F.col(of).alias("_block")).groupBy("_block")
    right = values.select("i", "v", F.expr(f"i div {block}").alias("_own_block")).groupBy("_own_block")
    drop = [c for c in asked.columns if c != of or of == "found"]
    return left.cogroup(right).applyInArrow(lambda a, v: look(a.select(drop), v), kind)


def _empty_or(look, names: list[str]):
    """look, where both sides have rows; no rows else."""

    def run(asked: pa.Table, values: pa.Table) -> pa.Table:
        return look(asked, values) if len(asked) and len(values) else pa.table([pa.array([], pa.int64())] * len(names), names=names)

    return run


def _seek(values: DataFrame, asked: DataFrame, block: int, size: int) -> DataFrame:
    """asked (i, v, side) with `found`, the nearest of the values (i, v) beyond i that is smaller than v; null where none is.

    Within the block first; what stays open goes, once for each block and value, to the blocks' minima, and so on up, until
    one block holds all.
    """
    here = asked.withColumn("_in", F.expr(f"i div {block}"))
    look = _empty_or(_smaller_beyond, ["i", "v", "side", "found"])
    inside = _with_blocks(here, values, block, "_in", look, "i long, v long, side long, found long")
    if size <= block:
        return inside
    inside = materialize(inside, "trie-inside").withColumn("of", F.expr(f"i div {block}"))
    open_ = inside.filter("found IS NULL")
    places = _places(values, open_.select(F.col("of").alias("i"), "v", "side").distinct(), block, size)
    far = open_.drop("found").join(places.withColumnRenamed("i", "of"), ["of", "v", "side"], "left").select("i", "v", "side", F.col("place").alias("found"))
    return inside.filter("found IS NOT NULL").select("i", "v", "side", "found").unionByName(far)


def _places(values: DataFrame, asked: DataFrame, block: int, size: int) -> DataFrame:
    """(i, v, side, place): of each asked (block i, v, side), the nearest smaller value in the blocks beyond; none where none is."""
    reached = _seek(_minima(values, block), asked, block, -(-size // block)).filter("found IS NOT NULL")
    look = _empty_or(_smaller_within, ["i", "v", "side", "place"])
    return materialize(_with_blocks(reached, values, block, "found", look, "i long, v long, side long, place long"), "trie-places")


def nearest_smaller(values: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(i, v, before, after), stored: for each of the values (i, v) the nearest places on both sides that hold less; null where none does.

    Blocks of `block` values are walked at once, each with a stack; a block sends up one question for each open value and side,
    to be answered from the minima of blocks.
    """
    local = values.groupBy(F.expr(f"i div {block}").alias("_block")).applyInArrow(_smaller_in_block, "i long, v long, before long, after long")
    local = materialize(local, "trie-local")
    if size <= block:
        return local
    local = local.withColumn("of", F.expr(f"i div {block}"))
    sides = {"before": -1, "after": 1}
    ask = [local.filter(F.col(c).isNull()).select(F.col("of").alias("i"), "v", F.lit(s).cast("long").alias("side")) for c, s in sides.items()]
    places = _places(values, ask[0].unionByName(ask[1]).distinct(), block, size)
    for c, s in sides.items():
        theirs = places.filter(F.col("side") == s).select(F.col("i").alias("of"), "v", "place")
        local = local.join(theirs, ["of", "v"], "left").withColumn(c, F.coalesce(c, "place")).drop("place")
    return materialize(local.select("i", "v", "before", "after"), "trie-smaller")


def _least(asked: pa.Table, values: pa.Table) -> pa.Table:
    i, v = _in_order(values)
    a, b = (np.searchsorted(i, asked[c].to_numpy()) for c in ("a", "b"))
    return pa.table([asked["a"], asked["b"], pa.array([int(v[x:y].min()) for x, y in zip(a, b)], pa.int64())], names=["a", "b", "least"])


def range_minimum(values: DataFrame, asked: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(l, r, least), stored: the least of the values (i, v) with l <= i < r for each asked (l, r), from block ends and minima of blocks."""
    lb, rb = F.expr(f"l div {block}"), F.expr(f"(r - 1) div {block}")
    part = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole, ends = F.array(part(F.col("l"), F.col("r"))), F.array(part(F.col("l"), (lb + 1) * block), part(rb * block, F.col("r")))
    parts = materialize(asked.select("l", "r", F.inline(F.when(lb == rb, whole).otherwise(ends))), "trie-parts")
    here = parts.select("a", "b").distinct().withColumn("_in", F.expr(f"a div {block}"))
    found = _with_blocks(here, values, block, "_in", _empty_or(_least, ["a", "b", "least"]), "a long, b long, least long")
    out = parts.join(found, ["a", "b"]).select("l", "r", "least")
    if size > 2 * block:
        inner = asked.filter(rb > lb + 1).select("l", "r", (lb + 1).alias("a"), rb.alias("b"))
        above = range_minimum(_minima(values, block), inner.select(F.col("a").alias("l"), F.col("b").alias("r")).distinct(), -(-size // block), block)
        out = out.unionByName(inner.join(above.select(F.col("l").alias("a"), F.col("r").alias("b"), "least"), ["a", "b"]).select("l", "r", "least"))
    return materialize(out.groupBy("l", "r").agg(F.min("least").alias("least")), "trie-least")


def running_sums(rows: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """rows (i, ...) with <name>_before for each name: the sum over smaller i. Blocks sum at once; one row a block gives their offsets."""
    own = rows.withColumn("_block", F.expr(f"i div {block}"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("_block").agg(*[F.sum(c).alias(c) for c in names])
    offsets = sums.select("_block", *[F.coalesce(F.sum(c).over(ahead(Window.orderBy("_block"))), F.lit(0)).alias(f"_{c}") for c in names])
    inside = {f"{c}_before": F.coalesce(F.sum(c).over(ahead(Window.partitionBy("_block").orderBy("i"))), F.lit(0)) + F.col(f"_{c}") for c in names}
    return own.join(offsets, "_block").withColumns(inside).drop("_block", *[f"_{c}" for c in names])


def _hashes(batches):
    """(i, ends_sha256) of rows (i, conv_id) that come sorted: ids are hashed as they pass, so a group of any size takes no memory."""
    group, state = None, None
    done: list[tuple[int, str]] = []
    for b in batches:
        for i, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i != group:
                if state is not None:
                    done.append((group, state.hexdigest()))
                group, state = i, hashlib.sha256(str(conv_id).encode())
            else:
                state.update(f",{conv_id}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.int64()), pa.array([h for _, h in done])], names=["i", "ends_sha256"])
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([state.hexdigest()])], names=["i", "ends_sha256"])


def end_hashes(words: DataFrame, sequences: DataFrame) -> DataFrame:
    """(i, ends_sha256): of each sequence, its conversations' ids, ascending. Only ids of repeated ones are sorted."""
    alone = sequences.filter("n = 1").select("i", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    copies = words.join(sequences.filter("n > 1").select("i", "word"), "word").select("i", "conv_id")
    held = copies.repartition("i").sortWithinPartitions("i", "conv_id").mapInArrow(_hashes, "i long, ends_sha256 string")
    return alone.unionByName(held)


def spelled_words(chunks: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(letter, marks, upto): distinct chunks in the order of their turns; and (conv_id, word, n_turns, chars): conversations as letters. Both stored."""
    letters = materialize(number_rows(chunks.select("marks", "upto").distinct(), ["marks"], "trie-chunk-order", "letter"), "trie-letters")
    spelled = chunks.join(letters.select("letter", "marks"), "marks").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "letter"))).alias("w"), F.sum(F.size("marks")).alias("n_turns"), F.sum(F.element_at("upto", -1)).alias("chars")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    word = F.coalesce(F.transform("w", lambda x: x["letter"]), F.array().cast("array<long>"))
    words = conversations.select("conv_id").join(spelled, "conv_id", "left").select("conv_id", word.alias("word"), zero("n_turns"), zero("chars"))
    return letters, materialize(words, "trie-words")


def neighbour_prefixes(sequences: DataFrame, letters: DataFrame, chunk: int) -> DataFrame:
    """(i, v), stored: how many turns sequence i and i - 1 begin with in common, from 1 on."""
    last = sequences.select((F.col("i") + 1).alias("i"), F.col("word").alias("last"))
    pairs = sequences.select("i", "word").join(last, "i").withColumn("same", common(F.col("word"), F.col("last")))
    at = lambda c: F.get(c, F.col("same").cast("int"))
    pairs = pairs.select("i", "same", at("word").alias("letter"), at("last").alias("last_letter"))
    theirs = letters.select(F.col("letter").alias("last_letter"), F.col("marks").alias("last_marks"))
    both = pairs.join(letters.select("letter", "marks"), "letter", "left").join(theirs, "last_letter", "left")
    none = F.array().cast("array<binary>")
    inside = common(F.coalesce("marks", none), F.coalesce("last_marks", none))
    return materialize(both.select("i", (F.col("same") * chunk + inside).alias("v")), "trie-prefixes")


def conversation_trie(conversations: DataFrame, *, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie.

    A conversation's turns become 16-byte marks (texts never move), chunks of them become letters in sorted order, and a
    conversation a word of letters: sorting the distinct words sorts the conversations by their turns, and a conversation of
    any length is one row of a long for each `chunk` turns. Neighbours' common prefixes are the array over which the nearest
    smaller values on both sides give the Cartesian tree: equal ones with the same interval are one node, a sequence that is
    no prefix of another is a leaf, and the depths that no node names lie on the edge above. Members, leaves and saved
    tokens of an interval are differences of running sums, its smallest id a minimum over it. Nothing is gathered but
    `chunk` turns, `block` values, and a word; ids of conversations that are all the same pass one task in order, since one hash takes them all.

    Rows are ordered by turn, null first, then role and mark (a hash of role and text), so ties have a fixed order and
    repeated rows repeat the turn. Null role and text count as empty. Rows without conv_id take no part. An empty table
    has no node, not even a root; extra columns are ignored.
    """
    turns, convs = numbered_turns(conversations)
    chunks = materialize(chunked(rebuilt_turns(turns, convs), chunk), "trie-chunks")
    letters, words = spelled_words(chunks, convs)
    once = words.groupBy("word").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("n_turns").alias("n_turns"), F.max("chars").alias("chars"))
    sequences = materialize(number_rows(once, ["word"], "trie-sequences", "i"), "trie-sequence-order")
    size = sequences.count()
    spelling = sequences.select("i", F.posexplode("word").alias("chunk", "letter")).join(letters.select("letter", F.element_at("upto", -1).alias("chars")), "letter")
    ahead = Window.partitionBy("i").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spelling = materialize(spelling.select("i", F.col("chunk").cast("long").alias("chunk"), "letter", F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("chars_before")), "trie-spelling")

    prefixes = neighbour_prefixes(sequences, letters, chunk)
    tree = nearest_smaller(prefixes, size, block).select("i", "v", F.coalesce("before", F.lit(0)).alias("l"), F.coalesce("after", F.lit(size)).alias("r"))
    level = lambda name, shift=0: prefixes.select((F.col("i") - shift).alias(name), F.col("v").alias(f"v_{name}"))
    outside = lambda c: F.coalesce(c, F.lit(-1))

    in_chunk = F.col("chars_before") + F.get("upto", ((F.col("v") - 1) % chunk).cast("int"))
    known = prefixes.filter("v > 0").withColumn("chunk", F.expr(f"(v - 1) div {chunk}")).join(spelling, ["i", "chunk"]).join(letters.select("letter", "upto"), "letter")
    shared = known.select("i", in_chunk.alias("shared"))
    seq = sequences.drop("word").join(level("i"), "i", "left").join(level("i", 1).withColumnRenamed("v_i", "v_next"), "i", "left").join(shared, "i", "left")
    seq = seq.withColumns({"v_i": outside("v_i"), "v_next": outside("v_next"), "weight": F.col("n") * F.col("chars"), "fresh": F.col("chars") - F.coalesce("shared", F.lit(0))})
    seq = seq.withColumn("leaf", (F.col("v_next") < F.col("n_turns")).cast("long"))
    seq = materialize(running_sums(seq, ["n", "weight", "fresh", "leaf"], block), "trie-sums")

    # A node's chain of depths runs from below its parent, the deeper of what bounds its interval, down to its own prefix.
    inner = tree.groupBy("l", "r").agg(F.max("v").alias("d1"), F.count("*").alias("cuts")).join(level("l"), "l", "left").join(level("r"), "r", "left")
    leaves = seq.filter("leaf = 1").select(F.col("i").alias("l"), (F.col("i") + 1).alias("r"), F.col("n_turns").alias("d1"), F.lit(None).cast("long").alias("cuts"), F.col("v_i").alias("v_l"), F.col("v_next").alias("v_r"))
    chains = inner.unionByName(leaves).withColumns({"v_l": outside("v_l"), "v_r": outside("v_r")})
    chains = chains.select("l", "r", "d1", "cuts", (F.greatest("v_l", "v_r") + 1).alias("d0"), F.when(F.col("v_l") >= F.col("v_r"), F.col("l")).otherwise(F.col("r")).alias("bound"))

    least = range_minimum(seq.select("i", F.col("conv_id").alias("v")), tree.select("l", "r").distinct(), size, block)
    parents = tree.join(least, ["l", "r"]).select(F.col("i").alias("bound"), F.col("least").alias("parent"))
    sums = ["n", "weight", "fresh", "leaf"]
    first = seq.select(F.col("i").alias("l"), F.col("conv_id").alias("own"), F.col("n_turns").alias("l_turns"), F.col("chars").alias("l_chars"), *[F.col(f"{c}_before").alias(f"{c}_l") for c in sums], F.col("fresh").alias("l_fresh"))
    last = seq.select((F.col("i") + 1).alias("r"), *[(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_r") for c in sums])
    ends = end_hashes(words, sequences).select(F.col("i").alias("l"), F.col("ends_sha256").alias("l_ends"))
    nodes = chains.join(first, "l").join(last, "r").join(least, ["l", "r"], "left").join(parents, "bound", "left").join(ends, "l")
    over = lambda c: F.col(f"{c}_r") - F.col(f"{c}_l")
    ended = F.col("l_turns") == F.col("d1")
    nodes = nodes.select(
        "l",
        "d0",
        "d1",
        "parent",
        F.coalesce("least", "own").alias("conv_id"),
        F.coalesce(F.col("cuts") + 1 - ended.cast("long"), F.lit(0)).alias("n_children"),
        over("n").alias("n_convs"),
        over("leaf").alias("n_leaves"),
        (over("weight") - F.col("l_chars") - (over("fresh") - F.col("l_fresh"))).alias("saved"),
        F.when(ended, F.col("l_ends")).otherwise(EMPTY_HASH).alias("ends"),
    )
    nodes = materialize(nodes, "trie-chains")
    return _expanded(nodes, spelling, letters, chunk)


def _expanded(nodes: DataFrame, spelling: DataFrame, letters: DataFrame, chunk: int) -> DataFrame:
    """The chains of nodes depth by depth: of a chain, only the last depth branches or has an end."""
    steps = F.sequence(F.expr(f"(greatest(d0, 1L) - 1) div {chunk}"), F.expr(f"(d1 - 1) div {chunk}"))
    below = nodes.filter("d1 > 0").withColumn("chunk", F.explode(steps))
    below = below.join(spelling.select(F.col("i").alias("l"), "chunk", "letter", "chars_before"), ["l", "chunk"]).join(letters.select("letter", "upto"), "letter")
    depths = F.sequence(F.expr(f"greatest(d0, chunk * {chunk} + 1)"), F.expr(f"least(d1, (chunk + 1) * {chunk})"))
    offset = (F.col("depth") - F.col("chunk") * chunk - 2).cast("int")
    before = F.col("chars_before") + F.when(offset >= 0, F.get("upto", offset)).otherwise(0)
    below = below.withColumn("depth", F.explode(depths)).withColumn("before", before)
    root = nodes.filter("d0 = 0").withColumns({"depth": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    every = below.select(*nodes.columns, "depth", "before").unionByName(root)
    last = F.col("depth") == F.col("d1")
    return every.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("d0"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(EMPTY_HASH).alias("ends_sha256"),
    )
