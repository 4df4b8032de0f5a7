"""Chunking: recursive splitting, sections, semantic cuts, and the metrics that choose."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LADDER = ("\n\n", "\n", ". ", " ")
#: Positions of a document that one task handles together; it changes how the work is spread, not what comes out.
STRETCH = 1000


def split_text(text: str, budget: int, overlap: int = 0, size=len) -> list[str]:
    """Pieces of at most budget units: cut at the coarsest separator that fits, else by characters.

    The parts are packed with single blanks; a piece begins with parts of the one before, up to overlap units.
    """
    if budget < 1 or not 0 <= overlap < budget:
        raise ValueError("budget must be at least 1 and overlap from 0 to under the budget")

    def atoms(part: str, rung: int) -> Iterator[str]:
        part = part.strip()
        if not part:
            return
        if size(part) <= budget:
            yield part
        elif rung == len(LADDER):
            at = 0
            while at < len(part):
                end = min(len(part), at + budget)
                while end > at + 1 and size(part[at:end]) > budget:
                    end -= 1
                yield part[at:end]
                at = end
        else:
            mark = LADDER[rung]
            pieces = part.split(mark)
            for k, p in enumerate(pieces):
                yield from atoms(p + (mark.rstrip() if k < len(pieces) - 1 else ""), rung + 1)

    out: list[str] = []
    now: list[str] = []
    fresh = False
    for atom in atoms(text, 0):
        if now and size(" ".join([*now, atom])) > budget:
            if fresh:
                out.append(" ".join(now))
            tail: list[str] = []
            for p in reversed(now):
                if size(" ".join([p, *tail])) > overlap:
                    break
                tail.insert(0, p)
            while tail and size(" ".join([*tail, atom])) > budget:
                tail.pop(0)
            now = tail
        now.append(atom)
        fresh = True
    if fresh:
        out.append(" ".join(now))
    return out


def recursive_chunks(docs: DataFrame, key: str, text: str, budget: int = 512, overlap: int = 64) -> DataFrame:
    """(key, ordinal, chunk) of every text, sizes in characters; blank and null texts give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, c) for k, t in zip(pdf["key"], pdf["text"]) for n, c in enumerate(split_text(t, budget, overlap))]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "chunk"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    return rows.mapInPandas(cut, f"key {docs.schema[key].dataType.simpleString()}, ordinal int, chunk string").withColumnRenamed("key", key)


def sections(items: DataFrame) -> DataFrame:
    """Adds section and stretch: headings (title, subtitle) open a section; what stands before the first is 0.

    Running counts within stretches of positions are chained over the stretches of a document, so that a
    very long document is spread, with pages or without. Items without a position come first.
    """
    rows = items.where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("source_doc_id").isNotNull())
    rows = rows.groupBy("item_id").agg(F.min(F.struct("source_doc_id", "seq", "role", "text", "level", "page")).alias("r")).select("item_id", "r.*")
    stretch = F.coalesce(F.floor(F.col("seq") / STRETCH), F.lit(-(2**31))).cast("int")
    rows = rows.withColumns({"stretch": stretch, "opens": F.coalesce(F.col("role").isin("title", "subtitle"), F.lit(False)).cast("int")})
    inner = Window.partitionBy("source_doc_id", "stretch").orderBy("seq", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy("source_doc_id", "stretch").agg(F.sum("opens").alias("n"))
    outer = Window.partitionBy("source_doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_doc_id", "stretch", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    out = rows.withColumn("within", F.sum("opens").over(inner)).join(before, ["source_doc_id", "stretch"])
    return out.withColumn("section", (F.col("before") + F.col("within")).cast("int")).drop("within", "before", "opens")


def _packed(held: int, size: int, budget: int) -> int:
    """Length of the open chunk after a text that fits the budget; 0 means that none is open."""
    return size if not held or held + 2 + size > budget else held + 2 + size


def structure_chunks(items: DataFrame, budget: int = 512, overlap: int = 64) -> DataFrame:
    """(source_doc_id, section, part, ordinal, kind, chunk): never across sections, tables alone, text packed with blank lines.

    part is the stretch of positions in which a chunk begins. Packing goes from text to text, but all that it
    hands on is the length of the open chunk. For sections over several stretches each stretch is first
    reduced to a map from that length on entry to the length on exit (a single number where all
    entries end alike), the maps alone are chained, and then every stretch is packed by itself. So a
    section with a third of all rows is spread and gives the same chunks as in one go.
    """
    rows = sections(items).select("source_doc_id", "section", "stretch", "seq", "item_id", F.coalesce("role", F.lit("text")).alias("role"), "text")
    place = ["source_doc_id", "section", "stretch"]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "item_id"])
        states, of = [*range(budget + 1)], [*range(budget + 1)]
        for role, size in zip(pdf["role"], pdf["size"]):
            alone = role == "table" or size > budget
            after = [0 if alone else _packed(h, size, budget) for h in states]
            if len(set(after)) < len(after):
                states = sorted(set(after))
                spot = {v: n for n, v in enumerate(states)}
                of = [spot[after[n]] for n in of]
            else:
                states = after
        exits = [states[n] for n in of]
        first = pdf.iloc[0]
        return pd.DataFrame([(first.source_doc_id, first.section, first.stretch, exits[:1] if len(states) == 1 else exits)], columns=[*place, "exits"])

    wide = rows.groupBy("source_doc_id", "section").agg(F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("lo < hi")
    sizes = rows.select(*place, "seq", "item_id", "role", F.char_length("text").alias("size")).join(wide, ["source_doc_id", "section"], "left_semi")
    maps = sizes.groupBy(*place).applyInPandas(reduce, "source_doc_id string, section int, stretch int, exits array<int>")
    # a map that does not depend on the entry starts a new chain, so chains are short but for texts all of one length
    order = Window.partitionBy("source_doc_id", "section").orderBy("stretch")
    before = F.lag(F.when(F.size("exits") == 1, F.col("exits")[0])).over(order)
    links = maps.withColumn("known", F.when(F.lag("stretch").over(order).isNull(), F.lit(0)).otherwise(before))
    links = links.withColumn("link", F.sum(F.col("known").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        held, out = int(pdf["known"].iloc[0]), []
        for exits in pdf["exits"]:
            out.append(held)
            held = int(exits[held] if len(exits) > 1 else exits[0])
        return pdf[place].assign(held=out)

    entries = links.groupBy("source_doc_id", "section", "link").applyInPandas(follow, "source_doc_id string, section int, stretch int, held int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "item_id"])
        out: list[tuple[str, str, bool]] = []
        texts: list[str] = []
        held, carried = int(pdf["held"].iloc[0]), bool(pdf["held"].iloc[0])

        def flush() -> None:
            nonlocal carried, held
            if texts:
                out.append(("text", "\n\n".join(texts), carried))
                texts.clear()
            carried, held = False, 0

        for role, text in zip(pdf["role"], pdf["text"]):
            if role == "table" or len(text) > budget:
                flush()
                kind = "table" if role == "table" else "text"
                out.extend((kind, c, False) for c in ([text] if len(text) <= budget else split_text(text, budget, overlap)))
            else:
                after = _packed(held, len(text), budget)
                if after == len(text):
                    flush()
                texts.append(text)
                held = after
        flush()
        first, n, made = pdf.iloc[0], -1, []
        for kind, text, on in out:
            n += not on
            made.append((first.source_doc_id, first.section, first.stretch, n, kind, text))
        return pd.DataFrame(made, columns=[*place, "ordinal", "kind", "chunk"])

    entered = rows.join(entries, place, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    pieces = entered.groupBy(*place).applyInPandas(pack, "source_doc_id string, section int, stretch int, ordinal int, kind string, chunk string")

    # ordinal -1: the rest of a chunk that began in an earlier stretch, the last one in which any began
    wider = pieces.join(wide, ["source_doc_id", "section"], "left_semi")
    began = wider.groupBy(*place).agg(F.max("ordinal").alias("last"))
    owner = F.last(F.when(F.col("last") >= 0, F.struct("stretch", "last")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    owners = began.select(*place, owner.alias("owner"))
    rest = wider.where("ordinal = -1").join(owners, place)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "chunk"))), lambda x: x["chunk"]), "\n\n")
    rest = rest.groupBy("source_doc_id", "section", F.col("owner.stretch").alias("stretch"), F.col("owner.last").alias("ordinal")).agg(joined.alias("rest"))
    out = pieces.where("ordinal >= 0").join(rest, [*place, "ordinal"], "left")
    return out.select("source_doc_id", "section", F.col("stretch").alias("part"), "ordinal", "kind", F.concat_ws("\n\n", "chunk", "rest").alias("chunk"))


def _once(value: Column, of) -> Column:
    """of(value), with the value bound as a variable, so that it is computed once and not for every place of an inner loop."""
    return F.transform(F.array(value), of)[0]


def neighbourhoods(sentences: Column, buffer: int = 2) -> Column:
    """Each sentence joined with up to buffer neighbours on either side; made within the row, so nothing moves."""
    first = lambda n: F.greatest(n - buffer, F.lit(0))
    return _once(sentences, lambda own: F.transform(own, lambda s, n: F.array_join(F.slice(own, first(n) + 1, n + buffer + 1 - first(n)), " ")))


def bag(words: Column, width: int = 64) -> Column:
    """Words counted in width places by their hash; a stand-in for a model's vector."""
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter(own, lambda s: s == k)).cast("double"))
    return _once(slots, counts)


def sentence_vectors(docs: DataFrame, key: str, text: str, width: int = 64, buffer: int = 0) -> DataFrame:
    """(key, pos, sentence, vector): sentences with hashed bags of the words around them, a stand-in for a model's vectors."""
    rows = docs.select(F.col(key).alias("key"), tx.sentences(F.col(text)).alias("all"))
    rows = rows.select("key", F.posexplode(F.arrays_zip(F.col("all").alias("sentence"), neighbourhoods(F.col("all"), buffer).alias("around"))).alias("pos", "s"))
    rows = rows.select("key", "pos", "s.sentence", "s.around")
    return rows.withColumn("words", tx.tokens(F.col("around"))).withColumn("vector", bag(F.col("words"), width)).drop("words", "around")


def semantic_cuts(vectors: DataFrame, percentile: float = 0.95) -> DataFrame:
    """Adds segment: a text is cut after a sentence whose gradient of the distance to the next lies strictly above the percentile.

    The distances are cosine distances of neighbours, the gradient has central differences inside and one-sided ones at the ends.
    """
    from ..functions.vectors import cosine

    w = Window.partitionBy("key").orderBy("pos")
    rows = vectors.withColumn("d", F.lit(1.0) - cosine(F.col("vector"), F.lead("vector").over(w)))
    before, after = F.lag("d").over(w), F.lead("d").over(w)
    slope = F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - F.col("d")).when(after.isNull(), F.col("d") - before).otherwise((after - before) / 2)
    rows = rows.withColumn("slope", F.when(F.col("d").isNotNull(), slope))
    limit = rows.groupBy("key").agg(F.percentile("slope", percentile).alias("limit"))
    rows = rows.join(limit, "key").withColumn("cut", F.coalesce(F.col("slope") > F.col("limit"), F.lit(False)).cast("int"))
    segment = F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("segment", segment.cast("int")).select("key", "pos", "sentence", "segment")


def semantic_chunks(docs: DataFrame, key: str, text: str, budget: int = 512, overlap: int = 64, buffer: int = 2) -> DataFrame:
    """(key, ordinal, chunk): the sentences of each segment, cut further where they are over the budget."""
    cut = semantic_cuts(sentence_vectors(docs, key, text, buffer=buffer))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    segments = cut.groupBy("key", "segment").agg(joined.alias("text"))
    whole = segments.select(F.struct("key", "segment").alias("id"), "text")
    parts = recursive_chunks(whole, "id", "text", budget, overlap)
    place = Window.partitionBy("id.key").orderBy("id.segment", "ordinal")
    return parts.select(F.col("id.key").alias(key), (F.row_number().over(place) - 1).alias("ordinal"), "chunk")


def size_share(tokens: Column, low: int = 100, high: int = 512) -> Column:
    """Share of chunks whose size lies within the limits; null without chunks."""
    return F.avg(tokens.between(low, high).cast("double"))


#: Words by which a block is looked up among the chunks of its document.
OPENING = 5


def whole_blocks(blocks: DataFrame, chunks: DataFrame, key: str, block: str, chunk: str) -> DataFrame:
    """(key, share): share of a document's blocks that stand whole, as runs of words, in one of its chunks.

    White space aside; repeated blocks count each time, blank ones not at all, and documents without blocks have no row.
    Blocks meet only chunks of their document in which their first five words (or all, if fewer) stand in
    a row, found by a hash of them; what is longer is then compared.
    """
    words = lambda c: F.filter(F.split(tx.normalised(c), " "), lambda w: w != "")
    b = blocks.select(key, words(F.col(block)).alias("w")).where(F.size("w") > 0).groupBy(key, F.array_join("w", " ").alias("block")).agg(F.count("*").alias("times"))
    w = F.split("block", " ")
    b = b.withColumn("run", F.xxhash64(F.array_join(F.slice(w, 1, OPENING), " ")))
    runs = lambda x, n: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(OPENING)), lambda k: F.when(n + k <= F.size("w"), F.array(F.xxhash64(F.array_join(F.slice("w", n + 1, k), " ")))).otherwise(F.array().cast("array<bigint>"))))
    c = chunks.select(key, words(F.col(chunk)).alias("w")).where(F.size("w") > 0).distinct()
    c = c.select(key, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("chunk"), F.explode(F.array_distinct(F.flatten(F.transform("w", runs)))).alias("run"))
    whole = b.join(c, [key, "run"]).where(F.col("chunk").contains(F.concat(F.lit(" "), F.col("block"), F.lit(" ")))).select(key, "block").distinct().withColumn("hit", F.lit(1.0))
    seen = b.join(whole, [key, "block"], "left")
    return seen.groupBy(key).agg((F.sum(F.coalesce("hit", F.lit(0.0)) * F.col("times")) / F.sum("times")).alias("share"))


def coherence(chunks: DataFrame, window: int = 3000) -> DataFrame:
    """(key, coherence): mean cosine of chunks with the windows of chunks that they stand in, from 0 to 1.

    chunks: (key, ordinal, size, vector), one row for each chunk. A window begins at each chunk and takes the next ones as
    long as their sizes add up to at most the limit; windows of fewer than two chunks count for nothing, documents without
    any have no row. A window's vector is the sum of its chunks' vectors, as bags of words add up. Frames
    reach as far as the limit, so no more of a document is held at once.
    """
    from ..functions.vectors import cosine

    order = Window.partitionBy("key").orderBy("ordinal")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    rows = chunks.select("key", "ordinal", F.col("size").cast("bigint").alias("size"), "vector").withColumn("start", start)
    rows = rows.withColumn("end", F.col("start") + F.col("size"))
    near = Window.partitionBy("key").orderBy("start").rangeBetween(0, window)
    rows = rows.withColumn("near", F.collect_list(F.struct("ordinal", "end", "vector")).over(near))
    rows = rows.withColumn("inside", F.transform(F.expr(f"filter(near, x -> x.ordinal >= ordinal and x.end <= start + {window})"), lambda x: x["vector"])).where(F.size("inside") >= 2)
    rows = rows.withColumn("total", F.aggregate(F.slice("inside", F.lit(2), F.size("inside")), F.col("inside")[0], lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q)))
    each = rows.select("key", F.explode("inside").alias("vector"), "total")
    mean = F.avg(F.coalesce(cosine(F.col("vector"), F.col("total")), F.lit(0.0)))
    return each.groupBy("key").agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("coherence"))


def parse_counts(items: DataFrame) -> DataFrame:
    """(source_doc_id, sections, chars, tables) of parsed documents, blank texts and repeats of an item aside."""
    rows = sections(items)
    return rows.groupBy("source_doc_id").agg((F.max("section") - F.min("section") + 1).alias("sections"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("role") == "table").alias("tables"))


def weighted_gate(metrics: dict[str, Column], weight: float = 0.25) -> Column:
    """Mean of the metrics that are there; 0 if none is."""
    total = sum((F.coalesce(m * weight, F.lit(0.0)) for m in metrics.values()), F.lit(0.0))
    weights = sum((F.when(m.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0)) for m in metrics.values()), F.lit(0.0))
    return F.coalesce(total / F.nullif(weights, F.lit(0.0)), F.lit(0.0))


def choose(candidates: DataFrame, key: str, order: tuple[str, ...] = ("structure_aware", "semantic", "fixed"), pinned: str | None = None) -> DataFrame:
    """The strategy with the best score per document; the earlier one of the order wins ties. candidates: (key, strategy, score).

    A pinned strategy is taken wherever it is a candidate; an unknown one is an error.
    """
    if pinned is not None:
        if pinned not in order:
            raise ValueError(f"unknown strategy {pinned!r}")
        candidates = candidates.where(F.col("strategy") == pinned)
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy")), F.lit(len(order) + 1))
    return candidates.groupBy(key).agg(F.max_by(F.struct("strategy", "score"), F.struct("score", -place)).alias("best")).select(key, "best.strategy", "best.score")


def cohesion(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, cohesion): mean over chunks of two or more sentences of the mean cosine of sentence and chunk, from 0 to 1.

    sentences: (key, chunk, vector); chunks: (key, chunk, vector). An average of averages, so that
    long chunks count once.
    """
    from ..functions.vectors import cosine

    rows = sentences.join(chunks.select("key", "chunk", F.col("vector").alias("whole")), ["key", "chunk"])
    per = rows.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.avg(cosine(F.col("vector"), F.col("whole"))).alias("mean")).where("n >= 2")
    return per.groupBy("key").agg(F.least(F.greatest(F.avg("mean"), F.lit(0.0)), F.lit(1.0)).alias("cohesion"))
