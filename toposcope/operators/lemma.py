"""Lemmas for tagged tokens ``(doc_id, line_no, tok_no, token, tag)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposcope.functions.text import cut_at, let
from toposcope.operators.terms import MAX_TERMS, common_rows
from toposcope.settings import computed_once, small, stored
from toposcope.sources.lexicon import SENTENCE_ENDS, STOP_TAGS, TREEBANK_TAGS

LINE_KEY = ("doc_id", "line_no")


def lexicon_by_form(lexicon: DataFrame) -> DataFrame:
    """``(form, default_lemma, pos_lemmas)``: the first lemma of a form and a map pos -> last lemma.

    One row per form, so that both look-ups are one join.
    """
    by_pos = lexicon.groupBy("form", "pos").agg(
        F.max_by("lemma", "line_no").alias("lemma"),
        F.min(F.struct("line_no", F.col("lemma").alias("first"))).alias("first"),
    )
    return by_pos.groupBy("form").agg(
        F.min("first")["first"].alias("default_lemma"),
        F.map_from_entries(F.collect_list(F.struct("pos", "lemma"))).alias("pos_lemmas"),
    )


def tag_to_pos(tag: Column, tags: dict[str, str] = TREEBANK_TAGS) -> Column:
    """Lexicon tag of a treebank tag, null for tags that are not in the map."""
    table = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    return F.try_element_at(table, tag)


def clean_tokens(tagged: DataFrame, tags: dict[str, str] = TREEBANK_TAGS) -> DataFrame:
    """Add ``raw`` (the part before a hyphen), ``form`` (lower case) and ``pos``."""
    return (
        tagged.withColumn("raw", F.split("token", "-")[0])
        .withColumn("form", F.lower("raw"))
        .withColumn("pos", tag_to_pos(F.col("tag"), tags))
    )


def with_fate(tagged: DataFrame, stop_tags: list[str] = STOP_TAGS) -> DataFrame:
    """Every token with its ``fate``: ``removed`` (stop tag), ``upper`` (all upper case, kept as it is), ``lemma``, or
    ``skipped`` (numbers and short tokens). It follows from the token alone, without the lexicon."""
    return clean_tokens(tagged).withColumn("fate", token_fate(F.col("raw"), F.col("pos"), stop_tags))


def token_fate(raw: Column, pos: Column, stop_tags: list[str] = STOP_TAGS) -> Column:
    usable = ~raw.rlike("^[0-9]+$") & (F.length(raw) > 2)
    return (
        F.when(F.coalesce(pos.isin(stop_tags), F.lit(False)), "removed")
        .when(~usable, "skipped")
        .when(F.upper(raw) == raw, "upper")
        .otherwise("lemma")
    )


def look_up(tagged: DataFrame, lexicon: DataFrame, stop_tags: list[str] = STOP_TAGS) -> DataFrame:
    """Every token with its fate (see ``with_fate``) and lemma.

    ``match``: ``pair``, ``form`` or ``none`` for lemma tokens.
    """
    words = small(stored(lexicon_by_form(lexicon)))
    pair = F.try_element_at("pos_lemmas", "pos")
    is_lemma = F.col("fate") == "lemma"
    return (
        with_fate(tagged, stop_tags)
        .join(words, "form", "left")
        .withColumn("pair_lemma", pair)
        .withColumn(
            "match",
            F.when(is_lemma & F.col("pair_lemma").isNotNull(), "pair")
            .when(is_lemma & F.col("default_lemma").isNotNull(), "form")
            .when(is_lemma, "none"),
        )
        .withColumn(
            "lemma",
            F.when(is_lemma, F.coalesce("pair_lemma", "default_lemma", "raw")).when(F.col("fate") == "upper", F.col("raw")),
        )
        .drop("pair_lemma", "default_lemma", "pos_lemmas")
    )


def removed_tokens(tokens: DataFrame) -> DataFrame:
    """``(Pos, Text)`` of each token dropped for its tag, of ``with_fate`` (no join) or ``look_up``."""
    return tokens.where("fate = 'removed'").select(F.col("pos").alias("Pos"), F.col("form").alias("Text"))


def lemma_text(looked_up: DataFrame, ends: list[str] = SENTENCE_ENDS, key: tuple[str, ...] = LINE_KEY) -> DataFrame:
    """``(key, sentence_no, text)``: lemmas joined by blanks; dropped end punctuation starts a new text line.

    An input line with n sentence ends gives n + 1 text lines, the last one often empty (which later
    separates paragraphs). The only group is one input line.
    """
    token = F.struct(
        F.col("tok_no"), F.coalesce((F.col("fate") == "removed") & is_end(F.col("pos"), F.col("form"), ends), F.lit(False)).alias("ends"), F.col("lemma")
    )
    # Tokens without a lemma stay in the group: a line of nothing else still gives its (empty) text lines.
    lines = looked_up.groupBy(*key).agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    return text_lines(lines, key)


def is_end(pos: Column, form: Column, ends: list[str] = SENTENCE_ENDS) -> Column:
    return (pos == "puncts") & form.isin(ends)


def text_lines(lines: DataFrame, key: tuple[str, ...] = LINE_KEY) -> DataFrame:
    """``(key, sentence_no, text)`` of lines with ``tokens``, an array of (tok_no, ends, lemma) in order."""

    def texts(items: Column) -> Column:
        def one(span: Column) -> Column:
            run = F.slice(items, span["after"] + 2, span["before"] - span["after"] - 1)
            return F.concat_ws(" ", F.transform(run, lambda t: t["lemma"]))

        return cut_at(items, lambda t: t["ends"], lambda spans: F.transform(spans, one))

    return lines.select(*key, F.posexplode(let(F.col("tokens"), texts)).alias("sentence_no", "text"))


def word_matrix(words: DataFrame) -> pa.Table:
    """The columns of ``words``, of bounded size: form, default lemma, tags and their lemmas."""
    return words.select("form", "default_lemma", F.map_keys("pos_lemmas").alias("tags"), F.map_values("pos_lemmas").alias("lemmas")).toArrow()


def common_lemmas(words: DataFrame, forms: Column, tags: Column, raws: Column) -> Column:
    """Lemma of each token of arrays whose form is among ``words`` (form, default_lemma, pos_lemmas), else null.

    ``words`` is of bounded size; it is shared with the tasks and looked up by Arrow.
    """
    table = word_matrix(words)
    names, first, pair_tags, pair_lemmas = (table[c].combine_chunks() for c in ("form", "default_lemma", "tags", "lemmas"))
    tag_names = pc.unique(pair_tags.flatten())
    own = pc.list_parent_indices(pair_tags).to_numpy().astype(np.int64) * len(tag_names)
    pairs = pa.array(own + pc.index_in(pair_tags.flatten(), value_set=tag_names).to_numpy(zero_copy_only=False).astype(np.int64))
    shared = words.sparkSession.sparkContext.broadcast((names, first, tag_names, pairs, pair_lemmas.flatten()))

    @F.arrow_udf("array<string>")
    def find(forms: pa.Array, tags: pa.Array, raws: pa.Array) -> pa.Array:
        names, first, tag_names, pairs, lemmas = shared.value
        ends = np.cumsum(pc.fill_null(pc.list_value_length(forms), 0).to_numpy(zero_copy_only=False))
        at = pc.index_in(forms.flatten(), value_set=names)
        tag = pc.index_in(tags.flatten(), value_set=tag_names)
        pair = pc.add(pc.multiply(at.cast(pa.int64()), len(tag_names)), tag.cast(pa.int64()))
        lemma = pc.coalesce(lemmas.take(pc.index_in(pair, value_set=pairs)), first.take(at), raws.flatten())
        lemma = pc.if_else(pc.is_valid(at), lemma, pa.scalar(None, lemma.type))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), lemma)

    return find(forms, tags, raws)


def lemma_lines(
    lines: DataFrame, lexicon: DataFrame, ends: list[str] = SENTENCE_ENDS, key: tuple[str, ...] = LINE_KEY, common: int = MAX_TERMS
) -> DataFrame:
    """``lemma_text`` of lines whose tokens are in the row: ``(key, tokens)``, an array of (tok_no, token, tag).

    The ``common`` most frequent forms are shared with the tasks and looked up in the row, with or without a lemma in
    the lexicon; only tokens of other forms cross the join. What has no text is left out of the row, and the rows are
    stored; lines are grouped once by ``key`` (parts of a line may come in several rows).
    """
    tokens = F.transform(
        "tokens",
        lambda t: let(
            F.struct(t["tok_no"].alias("tok_no"), F.split(t["token"], "-")[0].alias("raw"), tag_to_pos(t["tag"]).alias("pos")),
            lambda c: F.struct(
                c["tok_no"].alias("tok_no"), c["raw"].alias("raw"), F.lower(c["raw"]).alias("form"), c["pos"].alias("pos"),
                token_fate(c["raw"], c["pos"]).alias("fate"),
            ),
        ),
    )
    # Tested after the generator: Spark would move the test below it and work the tokens out twice.
    clean = computed_once(lines.select(*key, "tokens"), tokens, "tokens").where(F.size("tokens") > 0)
    wanted = F.transform(
        F.filter("tokens", lambda t: t["fate"] == "lemma"), lambda t: F.struct(t["tok_no"].alias("tok_no"), t["raw"].alias("raw"), t["form"].alias("form"), t["pos"].alias("pos"))
    )
    text = F.filter(
        F.transform(
            "tokens",
            lambda t: F.struct(
                t["tok_no"].alias("tok_no"),
                F.coalesce((t["fate"] == "removed") & is_end(t["pos"], t["form"], ends), F.lit(False)).alias("ends"),
                F.when(t["fate"] == "upper", t["raw"]).alias("lemma"),
            ),
        ),
        lambda t: t["ends"] | t["lemma"].isNotNull(),
    )
    split = stored(clean.select(*key, text.alias("text"), wanted.alias("wanted")))
    counts = split.select(F.explode("wanted.form").alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    words = stored(counts.join(lexicon_by_form(lexicon), "form", "left"))
    is_common = common_rows(words, "n", common)

    lemmas = common_lemmas(words.where(is_common), F.col("wanted.form"), F.col("wanted.pos"), F.col("wanted.raw"))
    found = computed_once(split, lemmas, "found")
    paired = F.zip_with("wanted", "found", lambda t, m: F.struct(t["tok_no"].alias("tok_no"), F.lit(False).alias("ends"), m.alias("lemma")))
    near = found.select(*key, F.concat("text", F.filter(paired, lambda t: t["lemma"].isNotNull())).alias("part"))
    open_ = F.filter(F.zip_with("wanted", "found", lambda t, m: F.when(m.isNull(), t)), lambda t: t.isNotNull())
    far = found.select(*key, F.inline(open_)).join(words.where(~is_common), "form", "left")
    lemma = F.coalesce(F.try_element_at("pos_lemmas", "pos"), "default_lemma", "raw")
    far = far.select(*key, F.array(F.struct("tok_no", F.lit(False).alias("ends"), lemma.alias("lemma"))).alias("part"))
    # Dealt out before the grouping: hardly any two rows of a task have the same key.
    parts = near.unionByName(far).repartition(*key)
    return text_lines(parts.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("tokens")), key)


def lemma_statistics(looked_up: DataFrame) -> DataFrame:
    """One row: scanned tokens, misses of (form, pos), misses of the form, different unknown forms."""
    unknown = F.col("match") == "none"
    return looked_up.agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("match").isin("form", "none")).alias("pair_misses"),
        F.count_if(unknown).alias("form_misses"),
        F.count_distinct(F.when(unknown, F.col("form"))).alias("unknown_forms"),
    )


def unknown_forms(looked_up: DataFrame) -> DataFrame:
    """``(form)``: different forms without a lemma."""
    return looked_up.where("match = 'none'").select("form").distinct()
