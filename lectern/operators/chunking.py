"""Sentence pieces, oversized splits and greedy chunk packing, all inside the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import kernels as K
from lectern.functions import text as T
from lectern.functions.plan import pin
from lectern.policies import DEFAULT_CHUNKS, PREEMPTIVE_CHUNKS, ChunkPolicy


def _runs(items: Column, starts: Column, make) -> Column:
    """Cut an array at 1-based start positions and build one value per run from (run, first position)."""
    n = F.size(starts)
    ends = F.when(n > 0, F.concat(F.slice(starts, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.size(items) + 1))).otherwise(starts)
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: make(F.slice(items, r["a"], r["b"] - r["a"]), r["a"]))


def _unit(src: Column, text: Column, opens: Column, tokens: Column) -> Column:
    return F.struct(
        src.alias("src"), text.alias("text"), T.utf16_length(text).alias("n_chars"), tokens.alias("n_tokens"), opens.cast("int").alias("opens")
    )


def split_array(df: DataFrame, texts: Column, out: str, policy: ChunkPolicy, cut: str = "sentences") -> DataFrame:
    """Adds `out`, an array of (src, text, n_chars, n_tokens): the pieces of every text in an array, in order.

    With `cut="sentences"` a text is cut into sentences and only those over a limit into words; with `cut="words"`
    every text is one run of words. Words are then packed greedily, all texts of the row in one linear pass.
    """

    def by_words(text: Column, src: Column) -> Column:
        return F.transform(T.words(text), lambda w, i: _unit(src, w, i == 0, F.lit(1)))

    def cut_sentence(whole: Column) -> Column:
        over = (whole["n_chars"] > policy.max_chars) | (whole["n_tokens"] > policy.max_tokens)
        return F.when(over, by_words(whole["text"], whole["src"])).otherwise(F.array(whole))

    def units(text: Column, src: Column) -> Column:
        if cut == "words":
            return by_words(text, src)
        sized = F.transform(T.sentences(text), lambda s: _unit(src, s, F.lit(True), T.count_words(s)))
        return F.flatten(F.transform(sized, cut_sentence))

    spacing = len(policy.spacing.encode("utf-16-be")) // 2
    with_units = df.withColumn("_units", F.flatten(F.transform(texts, lambda t, i: units(t, i))))
    pack = K.greedy_starts(policy.max_chars, policy.max_tokens)
    with_starts = with_units.withColumn(
        "_starts",
        pack(
            F.col("_units.n_chars"), F.col("_units.n_tokens"), F.transform("_units", lambda u: F.lit(spacing)), F.col("_units.opens")
        ),
    )

    def piece(run: Column, _first: Column) -> Column:
        first, n = run[0], F.size(run)
        packed = F.struct(
            first["src"].alias("src"),
            F.array_join(F.transform(run, lambda u: u["text"]), policy.spacing).alias("text"),
            (F.aggregate(run, F.lit(0), lambda a, u: a + u["n_chars"]) + (n - 1) * spacing).alias("n_chars"),
            n.alias("n_tokens"),
        )
        alone = F.struct(*[first[c].alias(c) for c in ("src", "text", "n_chars", "n_tokens")])
        return F.when(n == 1, alone).otherwise(packed)

    return pin(with_starts, out, _runs(F.col("_units"), F.col("_starts"), piece)).drop("_units", "_starts")


def split_segments(docs: DataFrame, policy: ChunkPolicy = DEFAULT_CHUNKS) -> DataFrame:
    """Adds `pieces`: every segment's sentences (oversized ones word-packed) with sizes, separators and owner.

    The separator is the text put before a piece when it is not the first of its chunk. Between two list items it
    depends on how the whole previous segment ends.
    """
    split = split_array(docs, F.transform("segments", lambda s: s["text"]), "_split", policy)
    owner = lambda p: F.get(F.col("segments"), p["src"])
    is_item = lambda s: (s["kind"] == "markdown") & (s["block_type"] == "list_item")

    def piece(p: Column, i: Column) -> Column:
        this, before = owner(p), owner(F.get(F.col("_split"), i - 1))
        between = F.when(T.ends_terminal(before["text"]), F.lit(" ")).otherwise(F.lit(policy.list_separator))
        sep = F.when((i > 0) & is_item(this) & is_item(before), between).otherwise(F.lit(policy.spacing))
        return F.struct(
            i.cast("int").alias("piece_idx"),
            this["segment_id"].alias("segment_id"),
            p["text"].alias("text"),
            p["n_chars"].alias("n_chars"),
            p["n_tokens"].alias("n_tokens"),
            sep.alias("sep"),
            this["kind"].alias("kind"),
            T.utf16_length(this["text"]).alias("segment_chars"),
        )

    return pin(split, "pieces", F.transform("_split", piece)).drop("_split")


def pack_chunks(docs: DataFrame, policy: ChunkPolicy = DEFAULT_CHUNKS) -> DataFrame:
    """Adds `chunks` from `pieces`: (chunk_idx, chunk_id, text, n_chars, n_tokens, first_piece, pieces)."""
    pack = K.greedy_starts(policy.max_chars, policy.max_tokens)
    started = docs.withColumn(
        "_starts",
        pack(
            F.col("pieces.n_chars"),
            F.col("pieces.n_tokens"),
            F.transform("pieces.sep", lambda sep: T.utf16_length(sep)),
            F.transform("pieces", lambda p: F.lit(0)),
        ),
    )

    def chunk(run: Column, first: Column) -> Column:
        joined = F.array_join(
            F.transform(run, lambda p, i: F.when(i == 0, p["text"]).otherwise(F.concat(p["sep"], p["text"]))), ""
        )
        return F.struct(
            T.js_trim(joined).alias("text"),
            F.aggregate(run, F.lit(0), lambda a, p: a + p["n_tokens"]).alias("n_tokens"),
            (first - 1).alias("first_piece"),
            F.transform(run, lambda p: F.struct(p["segment_id"].alias("segment_id"), p["text"].alias("text"))).alias("pieces"),
        )

    built = pin(started, "_chunks", _runs(F.col("pieces"), F.col("_starts"), chunk))
    chunks = F.transform(
        "_chunks",
        lambda c, i: F.struct(
            i.cast("int").alias("chunk_idx"),
            F.concat(F.lit("chunk_"), i.cast("string")).alias("chunk_id"),
            c["text"].alias("text"),
            T.utf16_length(c["text"]).alias("n_chars"),
            c["n_tokens"].alias("n_tokens"),
            c["first_piece"].alias("first_piece"),
            c["pieces"].alias("pieces"),
        ),
    )
    return built.withColumn("chunks", chunks).drop("_starts", "_chunks")


def chunk_documents(docs: DataFrame, policy: ChunkPolicy = DEFAULT_CHUNKS) -> DataFrame:
    """Pieces and chunks of nested documents; narrow from end to end."""
    return pack_chunks(split_segments(docs, policy), policy)


def explode_pieces(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per piece; when chunks are present, with its chunk and its UTF-16 offset in the untrimmed chunk text."""
    if "chunks" not in docs.columns:
        return docs.select(*keys, F.inline("pieces"))
    # A piece and the separator after it; running sums give every offset in one pass over the row.
    following = lambda i: F.coalesce(T.utf16_length(F.get("pieces.sep", i + 1)), F.lit(0))
    summed = docs.withColumn("_before", K.sums_before(F.transform("pieces", lambda p, i: p["n_chars"] + following(i))))
    summed = pin(summed, "_at", F.col("_before"))
    places = F.flatten(
        F.transform(
            "chunks",
            lambda c: F.transform(
                c["pieces"],
                lambda p: F.struct(c["chunk_idx"].alias("chunk_idx"), F.get(F.col("_at"), c["first_piece"]).alias("origin")),
            ),
        )
    )
    zipped = F.arrays_zip(F.col("pieces").alias("p"), places.alias("c"), F.col("_at").alias("b"))
    return summed.select(*keys, F.explode(zipped).alias("z")).select(
        *keys, "z.p.*", F.col("z.c.chunk_idx").alias("chunk_idx"), (F.col("z.b") - F.col("z.c.origin")).cast("int").alias("char_offset")
    )


def explode_chunks(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.inline("chunks"))


def split_for_retry(df: DataFrame, text: str = "text", out: str = "parts", policy: ChunkPolicy = DEFAULT_CHUNKS) -> DataFrame:
    """Adds `out`, the sub-texts to synthesise after a failure.

    Two or more sentences: both halves, re-split into sentence pieces. One sentence: words at half the limits.
    """
    ready = df.withColumn("_sent", T.sentences(T.js_trim(F.col(text))))
    n = F.size("_sent")
    middle = F.ceil(n / F.lit(2.0)).cast("int")
    halves = F.filter(
        F.array(
            T.js_trim(F.array_join(F.slice("_sent", F.lit(1), middle), policy.spacing)),
            T.js_trim(F.array_join(F.slice("_sent", middle + 1, F.greatest(n - middle, F.lit(0))), policy.spacing)),
        ),
        lambda h: h != "",
    )
    nothing = F.array().cast("array<string>")
    many = split_array(ready, F.when(n >= 2, halves).otherwise(nothing), "_many", policy)
    one = split_array(many, F.when(n == 1, F.array(T.js_trim(F.col(text)))).otherwise(nothing), "_one", policy.halved(), cut="words")
    parts = F.transform(F.concat("_many", "_one"), lambda p: p["text"])
    return one.withColumn(out, parts).drop("_sent", "_many", "_one")


def preemptive_split(segments: DataFrame, segment_id: str = "segment_id", text: str = "text") -> DataFrame:
    """Long segments become `id::chunk_i` rows before synthesis; the others pass unchanged. Adds `parent_id`."""
    trimmed = T.js_trim(F.col(text))
    long = (T.utf16_length(trimmed) > PREEMPTIVE_CHUNKS.max_chars) | (T.estimate_tokens(trimmed) > PREEMPTIVE_CHUNKS.max_tokens)
    split = split_for_retry(segments.withColumn("_long", F.when(long, trimmed)), "_long", "_parts", PREEMPTIVE_CHUNKS)
    parent = F.col(segment_id)
    rows = F.when(
        F.size("_parts") >= 2,
        F.transform("_parts", lambda p, i: F.struct(F.concat(parent, F.lit("::chunk_"), i.cast("string")).alias("id"), p.alias("text"))),
    ).otherwise(F.array(F.struct(parent.alias("id"), F.col(text).alias("text"))))
    others = [c for c in segments.columns if c not in (segment_id, text)]
    flat = split.select(*others, parent.alias("parent_id"), F.size("_parts").alias("_n"), F.posexplode(rows).alias("part_idx", "_r"))
    return flat.select(
        *others, "parent_id", "part_idx", F.col("_r.id").alias(segment_id), F.col("_r.text").alias(text),
        (F.col("_n") >= 2).alias("was_split"),
    )
