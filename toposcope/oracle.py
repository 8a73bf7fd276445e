"""The catalogue's queries in SQL for DuckDB, to check results by value.

Written from the definitions, with window functions and grouping instead of the library's array
expressions.
"""

from __future__ import annotations

from toposcope.catalogue import MIN_DF, STOP_WORDS
from toposcope.operators.report import TOPIC_LABELS, UNKNOWN
from toposcope.sources.lexicon import SENTENCE_ENDS, STOP_TAGS, TREEBANK_TAGS


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = f"[{quoted(STOP_WORDS)}]"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


LINES = """
lines AS (
  SELECT doc_id, lang, source, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, lang, source, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS l FROM documents)
)"""


def segments(lines: str, doc: str, order: str, line: str = "line", extra: str = "") -> str:
    """Tagged lines, their separator and the number of separators before and after them."""
    return f"""
toks AS (
  SELECT {doc}, {order}{extra}, list_filter(string_split({line}, ' '), lambda t: length(t) > 2) AS toks FROM {lines}
),
sep AS (
  SELECT *, len(toks) = 0 OR len(list_filter(toks, lambda t: upper(t) = t)) > 0 AS is_sep FROM toks
),
isl AS (
  SELECT *, sum(is_sep::INT) OVER (PARTITION BY {doc} ORDER BY {order}) AS island,
         sum(is_sep::INT) OVER (PARTITION BY {doc}) AS n_sep,
         max({order}) OVER (PARTITION BY {doc}) AS last_line
  FROM sep
)"""


DOC_SEGMENTS = LINES + "," + segments("lines", "doc_id", "line_no", extra=", lang, source")

PARAS = (
    DOC_SEGMENTS
    + """,
islands AS (
  SELECT doc_id, lang, source, island, flatten(list(toks ORDER BY line_no)) AS words,
         bool_or(island < n_sep) AS closed
  FROM isl WHERE NOT is_sep GROUP BY ALL
),
paras AS (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS para_no, words FROM islands
)"""
)

FILTERED = (
    PARAS
    + f""",
filtered_all AS (
  SELECT * REPLACE (list_filter(words, lambda w: NOT list_contains({STOP}, lower(w))) AS words) FROM paras
),
filtered AS (SELECT * FROM filtered_all WHERE len(words) > 0),
nd AS (SELECT count(*) AS n_docs FROM filtered)"""
)

TERMS = (
    FILTERED
    + """,
dt AS (
  SELECT doc_id, para_no, lang, term, count(*) AS tf
  FROM (SELECT doc_id, para_no, lang, unnest(words) AS term FROM filtered) GROUP BY ALL
)"""
)

FREQS = (
    TERMS
    + f""",
freq AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM dt GROUP BY term HAVING count(*) >= {MIN_DF}
)"""
)

VOCAB = (
    FREQS
    + """,
vocab AS (SELECT row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_id, term, df, cf FROM freq)"""
)

WEIGHTS = (
    VOCAB
    + """,
weighed AS (
  SELECT doc_id, para_no, lang, term, term_id, tf, ln((n_docs + 1) / (df + 1)) AS idf,
         sum(tf) OVER (PARTITION BY doc_id, para_no) AS total
  FROM dt JOIN vocab USING (term), nd
)"""
)

TOPICS = (
    WEIGHTS
    + f""",
topic_sums AS (
  SELECT lang AS topic, term, {r6("sum(idf * tf / total)")} AS weight FROM weighed GROUP BY ALL
),
topics AS (
  SELECT * FROM (
    SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank, term, weight FROM topic_sums
  ) WHERE rank <= 10
)"""
)

COOC = (
    TOPICS
    + """,
pairs AS (
  SELECT a.topic, a.term AS wi, b.term AS wj FROM topics a JOIN topics b ON a.topic = b.topic AND b.rank < a.rank
),
needed AS (SELECT DISTINCT doc_id, para_no, term FROM dt WHERE term IN (SELECT term FROM topics)),
together AS (
  SELECT topic, wi, wj, count(*) AS n_both
  FROM pairs JOIN needed x ON x.term = wi JOIN needed y ON y.term = wj AND x.doc_id = y.doc_id AND x.para_no = y.para_no
  GROUP BY ALL
),
cooc AS (
  SELECT topic, wi, wj, coalesce(n_both, 0) AS n_both, df AS n_wj
  FROM pairs LEFT JOIN together USING (topic, wi, wj) JOIN freq ON freq.term = wj
),
umass AS (
  SELECT topic, sum(ln(n_both + 1.0) - ln(n_wj)) / (10 * 9) AS umass FROM cooc GROUP BY topic
)"""
)

VECTORS = (
    TOPICS
    + """,
vecs AS (SELECT term AS word, term_id, embedding::DOUBLE[] AS vec FROM vocab JOIN embeddings ON vec_id = term_id)"""
)

DIMS = """
dims AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings),
means AS (SELECT label, dim, avg(value) AS mean FROM dims GROUP BY ALL),
centres AS (SELECT label AS topic, list(mean ORDER BY dim) AS centre FROM means GROUP BY label),
scored AS (
  SELECT vec_id AS doc_id, topic, list_cosine_similarity(embedding::DOUBLE[], centre) AS cosine,
         list_distance(embedding::DOUBLE[], centre) ** 2 AS sqdist
  FROM embeddings, centres
),
tmap AS (
  SELECT doc_id, topic, cosine AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic) AS rank
  FROM scored
)"""

NEAR_WORDS = (
    VECTORS
    + ","
    + DIMS
    + """,
word_scores AS (
  SELECT topic, word AS term, list_cosine_similarity(vec, centre) AS cosine, list_distance(vec, centre) ** 2 AS sqdist
  FROM vecs, centres
),
near AS (
  SELECT * FROM (
    SELECT topic, term, cosine AS weight, row_number() OVER (PARTITION BY topic ORDER BY cosine DESC, term) AS rank
    FROM word_scores
  ) WHERE rank <= 10
)"""
)

LABELS = ", ".join(f"({i}, {t}, '{label}')" for i, (t, label) in enumerate(TOPIC_LABELS))

MERGED = (
    DIMS
    + f""",
labels17 AS (SELECT * FROM (VALUES {LABELS}) AS v(raw_topic, merged, label)),
relabelled AS (
  SELECT doc_id, rank, merged AS topic, label, weight,
         first_value(weight) OVER (PARTITION BY doc_id ORDER BY rank) AS top_weight,
         row_number() OVER (PARTITION BY doc_id, merged ORDER BY rank) AS occurrence
  FROM tmap JOIN labels17 ON raw_topic = tmap.topic
),
merged AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place FROM relabelled WHERE occurrence = 1
  ) WHERE place <= 2
),
shares AS (
  SELECT doc_id, topic, label, trunc((40 * top_weight) * (weight / total))::INT AS share
  FROM (SELECT *, sum(weight) OVER (PARTITION BY doc_id) AS total FROM merged) WHERE total <> 0
)"""
)

MEASURES = (
    DIMS
    + """,
by_rank AS (SELECT rank AS k, avg(weight) AS word2vec, sum(1 - weight) AS wsse FROM tmap GROUP BY rank)"""
)

TAGGED = (
    LINES
    + r""",
tokens AS (
  SELECT doc_id, line_no, generate_subscripts(t, 1) - 1 AS tok_no, unnest(t) AS token
  FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[\p{L}\p{N}-]+|[.,!?;:]') AS t FROM lines)
),
tagged AS (
  SELECT *, CASE WHEN regexp_full_match(token, '[.,!?;:]') THEN 'PUNC' WHEN length(token) <= 3 THEN 'DET'
                 WHEN length(token) % 5 = 0 THEN 'NC' WHEN length(token) % 5 = 1 THEN 'V'
                 WHEN length(token) % 5 = 2 THEN 'ADV' WHEN length(token) % 5 = 3 THEN 'ADJ' ELSE 'XX' END AS tag
  FROM tokens
)"""
)

TAG_ROWS = ", ".join(f"('{t}', '{p}')" for t, p in TREEBANK_TAGS.items())

LEMMAS = (
    TAGGED
    + ","
    + DOC_SEGMENTS.replace(LINES + ",", "")
    + f""",
forms AS (SELECT DISTINCT lower(unnest(toks)) AS form FROM isl WHERE NOT is_sep),
lexicon AS (
  SELECT form, 'nc' AS pos, left(form, length(form) - 1) AS lemma, 1 AS line_no FROM forms WHERE length(form) % 3 <> 0
  UNION ALL SELECT form, 'v', form || 'r', 2 FROM forms WHERE length(form) % 2 = 0
  UNION ALL SELECT form, 'v', form || 'er', 3 FROM forms WHERE length(form) % 4 = 0
),
pair_lemma AS (SELECT form, pos, max_by(lemma, line_no) AS pair FROM lexicon GROUP BY ALL),
form_lemma AS (SELECT form, min_by(lemma, line_no) AS def FROM lexicon GROUP BY form),
tag_map AS (SELECT * FROM (VALUES {TAG_ROWS}) AS v(tag, pos)),
clean AS (
  SELECT doc_id, line_no, tok_no, string_split(token, '-')[1] AS raw, lower(string_split(token, '-')[1]) AS form, pos
  FROM tagged LEFT JOIN tag_map USING (tag)
),
found AS (
  SELECT clean.*, pair, def,
    CASE WHEN pos IN ({quoted(STOP_TAGS)}) THEN 'removed'
         WHEN regexp_full_match(raw, '[0-9]+') OR length(raw) <= 2 THEN 'skipped'
         WHEN upper(raw) = raw THEN 'upper' ELSE 'lemma' END AS fate
  FROM clean LEFT JOIN pair_lemma USING (form, pos) LEFT JOIN form_lemma ON form_lemma.form = clean.form
),
lemmas AS (
  SELECT *, CASE fate WHEN 'upper' THEN raw WHEN 'lemma' THEN coalesce(pair, def, raw) END AS lemma,
         (fate = 'removed' AND pos = 'puncts' AND form IN ({quoted(SENTENCE_ENDS)}))::INT AS is_end
  FROM found
)"""
)


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


TEXT = "doc_id, para_no, len(words) AS n_words, array_to_string(words, ' ') AS content"


def wide(rank_table: str, key: str, name: str, n: int, first: tuple[str, str], second: tuple[str, str]) -> str:
    cols = ", ".join(
        f"max({first[0]}) FILTER (WHERE rank = {i}) AS {first[1]}_{i}, "
        f"{r6(f'max({second[0]}) FILTER (WHERE rank = {i})')} AS {second[1]}_{i}"
        for i in range(1, n + 1)
    )
    return f"SELECT {key} AS {name}, {cols} FROM {rank_table} WHERE rank <= {n} GROUP BY {key}"


def weight_sql(expr: str, term: str = "term") -> str:
    return with_(WEIGHTS, f"SELECT doc_id, para_no, {term}, {r6(expr)} AS weight FROM weighed")


def nearest_sql(column: str, direction: str) -> str:
    return f"""SELECT * FROM (
  SELECT doc_id, topic, {r6(column)} AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY {column} {direction}, topic) AS rank
  FROM scored) WHERE rank <= 5"""


SPLIT = "('0x' || substr(md5(doc_id::VARCHAR || ':' || para_no::VARCHAR || ':1'), 1, 8))::BIGINT % 1000"


def _digamma(x: str) -> str:
    """The series of ``operators.heldout.digamma`` in SQL."""
    y = f"(({x}) + 6)"
    i2 = f"(1.0 / ({y} * {y}))"
    series = f"(ln({y}) - 0.5 / {y} - {i2} * (1.0 / 12 - {i2} * (1.0 / 120 - {i2} * (1.0 / 252 - {i2} * (1.0 / 240 - {i2} / 132)))))"
    return f"({series} - (" + " + ".join(f"1.0 / (({x}) + {i})" for i in range(6)) + "))"


def _log_gamma(x: str) -> str:
    """The series of ``operators.heldout.log_gamma`` in SQL."""
    y = f"(({x}) + 6)"
    i2 = f"(1.0 / ({y} * {y}))"
    series = f"(({y} - 0.5) * ln({y}) - {y} + 0.5 * ln(2 * pi()) + (1.0 / {y}) * (1.0 / 12 - {i2} * (1.0 / 360 - {i2} * (1.0 / 1260 - {i2} / 1680))))"
    return f"({series} - (" + " + ".join(f"ln(({x}) + {i})" for i in range(6)) + "))"


def queries() -> dict[str, str]:
    """SQL by query name."""
    sql = {
        "line_tokens": with_(
            DOC_SEGMENTS,
            "SELECT doc_id, line_no, generate_subscripts(toks, 1) - 1 AS token_no, unnest(toks) AS token FROM toks",
        ),
        "separator_lines": with_(DOC_SEGMENTS, "SELECT doc_id, line_no, len(toks) AS n_tokens FROM sep WHERE is_sep"),
        "paragraphs_closed": with_(
            PARAS,
            "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS para_no, "
            "len(words) AS n_words, array_to_string(words, ' ') AS content FROM islands WHERE closed",
        ),
        "paragraphs_all": with_(PARAS, f"SELECT {TEXT} FROM paras"),
        "paragraphs_next_line": with_(
            LINES.replace("unnest(l) AS line", "trim(unnest(l), ' ' || chr(13)) AS line")
            + ","
            + segments("lines", "doc_id", "line_no")
            + f""",
islands AS (
  SELECT a.doc_id, a.island, list_filter(flatten(list(a.toks ORDER BY a.line_no)), lambda w: NOT list_contains({STOP}, w)) AS words
  FROM isl a JOIN isl s ON s.doc_id = a.doc_id AND s.is_sep AND s.island = a.island + 1 AND s.line_no < s.last_line
  WHERE NOT a.is_sep GROUP BY ALL
),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS para_no, words FROM islands WHERE len(words) > 0
)""",
            f"SELECT {TEXT} FROM paras",
        ),
        "paragraph_lines": with_(
            DOC_SEGMENTS,
            "SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS para_no, line_no, "
            "array_to_string(toks, ' ') AS content FROM isl WHERE NOT is_sep AND island < n_sep",
        ),
        "conversation_paragraphs": with_(
            segments("conversations", "conv_id", "turn", "text"),
            "SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY island) - 1 AS para_no, turn, "
            "array_to_string(toks, ' ') AS content FROM isl WHERE NOT is_sep",
        ),
        "stopword_filter_ci": with_(FILTERED, f"SELECT {TEXT} FROM filtered"),
        "stopword_filter_cs": with_(
            PARAS,
            f"SELECT {TEXT} FROM (SELECT doc_id, para_no, list_filter(words, lambda w: NOT list_contains({STOP}, w)) AS words "
            "FROM paras) WHERE len(words) > 0",
        ),
        "nonempty_docs": with_(
            FILTERED, "SELECT count(*) AS n_docs, count(*) FILTER (WHERE len(words) > 0) AS n_nonempty FROM filtered_all"
        ),
        "term_freq": with_(TERMS, "SELECT doc_id, para_no, term, tf FROM dt"),
        "term_freq_by_source": with_(
            FILTERED,
            "SELECT source, term, count(*) AS tf FROM (SELECT source, unnest(words) AS term FROM filtered) GROUP BY ALL",
        ),
        "doc_freq": with_(FREQS, "SELECT * FROM freq"),
        "vocabulary": with_(VOCAB, "SELECT * FROM vocab WHERE term_id < 262144"),
        "vocabulary_unbounded": with_(VOCAB, "SELECT * FROM vocab"),
        "trim_vocab_most": with_(FREQS, "SELECT * FROM freq ORDER BY df DESC, term LIMIT 1000"),
        "trim_vocab_least": with_(FREQS, "SELECT * FROM freq ORDER BY df, term LIMIT 1000"),
        "hashed_ledger": with_(
            FREQS,
            "SELECT slot, count(*) AS n_terms, sum(cf)::BIGINT AS cf, (sum(cf) - max(cf))::BIGINT AS lost_cf, sum(sign * cf)::BIGINT AS signed_cf FROM ("
            "SELECT *, (('0x' || substr(md5(term), 1, 8))::BIGINT % 4096)::INT AS slot, "
            "CASE WHEN ('0x' || substr(md5(term), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM freq) GROUP BY slot HAVING count(*) >= 2",
        ),
        "min_nonzeros": with_(
            FREQS,
            "SELECT doc_id, para_no, count(*) AS n_terms FROM dt JOIN freq USING (term) GROUP BY ALL HAVING count(*) > 20",
        ),
        "dict_filter": r"""
WITH words AS (
  SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}_]+'),
         lambda w: length(w) BETWEEN 2 AND 15 AND NOT starts_with(w, '_'))) AS term FROM documents
),
counts AS (SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term)
SELECT term, df FROM counts WHERE df >= 11 AND df <= 0.5 * (SELECT count(*) FROM documents)
""",
        "corpus_sizes": with_(
            FREQS,
            "SELECT count(*) AS n_terms, sum(df)::BIGINT AS n_pairs, sum(cf)::BIGINT AS n_words, "
            "(SELECT n_docs FROM nd) AS n_docs FROM freq",
        ),
        "idf": with_(FREQS, f"SELECT term, df, {r6('ln((n_docs + 1) / (df + 1))')} AS idf FROM freq, nd"),
        "tf_consistency": with_(
            TERMS,
            "SELECT count(*) AS n_checked, sum(tf)::BIGINT AS n_words, "
            "count(*) FILTER (WHERE tf <= 0 OR NOT list_contains(words, term)) AS n_bad "
            "FROM dt LEFT JOIN filtered USING (doc_id, para_no)",
        ),
        "tfidf_lsa": weight_sql("idf * tf / total"),
        "tfidf_ml": weight_sql("tf * idf"),
        "tf2idf_norm": weight_sql("tf * (tf * idf) / total"),
        "tfidf_ntc": with_(
            WEIGHTS,
            f"SELECT doc_id, para_no, term, {r6('CASE WHEN size > 0 THEN tf * idf / size ELSE 0.0 END')} AS weight FROM "
            "(SELECT *, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, para_no)) AS size FROM weighed)",
        ),
        "tfidf_lsa_vectors": weight_sql("idf * tf / total", "term_id"),
        "tf2idf_norm_vectors": weight_sql("tf * (tf * idf) / total", "term_id"),
        "language_topics": with_(TOPICS, "SELECT * FROM topics"),
        "cooccurrence": with_(COOC, "SELECT * FROM cooc"),
        "umass_by_topic": with_(COOC, f"SELECT topic, {r6('umass')} AS umass, 0 AS null_pairs FROM umass"),
        "umass_mean": with_(COOC, f"SELECT {r6('sum(umass) / count(*)')} AS umass FROM umass"),
        "doc_vectors": with_(
            VECTORS
            + """,
known AS (SELECT doc_id, para_no, tf * (tf * idf) AS w, vec FROM weighed JOIN vecs USING (term_id)),
parts AS (SELECT doc_id, para_no, w, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS value FROM known),
sums AS (SELECT doc_id, para_no, dim, sum(w * value) AS s, sum(w) AS w FROM parts GROUP BY ALL),
all_docs AS (SELECT doc_id, para_no, unnest(range(64)) AS dim FROM (SELECT DISTINCT doc_id, para_no FROM weighed))""",
            f"SELECT doc_id, para_no, dim, {r6('CASE WHEN coalesce(w, 0) <> 0 THEN s / w ELSE 0.0 END')} AS value "
            "FROM all_docs LEFT JOIN sums USING (doc_id, para_no, dim)",
        ),
        "embed_coherence": with_(
            VECTORS
            + """,
tv AS (SELECT topic, rank, vec FROM topics LEFT JOIN vecs ON word = term),
cos AS (
  SELECT a.topic, sum(list_cosine_similarity(a.vec, b.vec)) AS total
  FROM tv a JOIN tv b ON a.topic = b.topic AND b.rank < a.rank GROUP BY a.topic
)""",
            f"SELECT topic, {r6('coalesce(max(total), 0.0) / (10 * 45)')} AS coherence, "
            "count(*) FILTER (WHERE vec IS NULL) AS unknown FROM tv LEFT JOIN cos USING (topic) GROUP BY topic",
        ),
        "embeddings_text": with_(
            DIMS, f"SELECT vec_id::VARCHAR AS word, dim - 1 AS dim, {r6('value')} AS value FROM dims"
        ),
        "nearest_clusters": with_(DIMS, nearest_sql("cosine", "DESC")),
        "nearest_clusters_euclidean": with_(DIMS, nearest_sql("sqdist", "ASC")),
        "nearest_words": with_(NEAR_WORDS, f"SELECT topic, rank, term, {r6('weight')} AS weight FROM near"),
        "nearest_words_euclidean": with_(
            NEAR_WORDS,
            f"SELECT * FROM (SELECT topic, term, {r6('sqdist')} AS weight, "
            "row_number() OVER (PARTITION BY topic ORDER BY sqdist, term) AS rank FROM word_scores) WHERE rank <= 10",
        ),
        "divergence_words": with_(
            FREQS
            + f""",
lt AS (SELECT lang AS feature, term, sum(tf) AS tf FROM dt GROUP BY ALL),
profile AS (
  SELECT term, feature, tf / sum(tf) OVER (PARTITION BY feature) AS w FROM lt
),
mix AS (SELECT source AS topic, lang AS feature, count(*) AS n FROM paras GROUP BY ALL),
centre AS (SELECT topic, feature, n / sum(n) OVER (PARTITION BY topic) AS c FROM mix),
grid AS (
  SELECT centre.topic, centre.feature, freq.term, c, coalesce(w, 0.0) AS w
  FROM centre CROSS JOIN freq LEFT JOIN profile ON profile.term = freq.term AND profile.feature = centre.feature
),
div AS (
  SELECT topic, term, {r6('''sum(CASE WHEN w > 0 THEN w * (ln(2 * w) - ln(w + c)) ELSE 0.0 END
    + CASE WHEN c > 0 THEN c * (ln(2 * c) - ln(w + c)) ELSE 0.0 END)''')} AS weight
  FROM grid GROUP BY ALL
)""",
            "SELECT * FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight, term) AS rank, term, weight "
            "FROM div) WHERE rank <= 10",
        ),
        "lemmatise": with_(
            LEMMAS
            + """,
placed AS (
  SELECT *, sum(is_end) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) - is_end AS sentence_no FROM lemmas
),
every_sentence AS (
  SELECT doc_id, line_no, unnest(range(sum(is_end)::BIGINT + 1)) AS sentence_no FROM lemmas GROUP BY doc_id, line_no
),
texts AS (
  SELECT doc_id, line_no, sentence_no, string_agg(lemma, ' ' ORDER BY tok_no) AS text FROM placed GROUP BY ALL
)""",
            "SELECT doc_id, line_no, sentence_no, coalesce(text, '') AS text "
            "FROM every_sentence LEFT JOIN texts USING (doc_id, line_no, sentence_no)",
        ),
        "lemma_stats": with_(
            LEMMAS,
            "SELECT count(*) AS scanned, count(*) FILTER (WHERE fate = 'lemma' AND pair IS NULL) AS pair_misses, "
            "count(*) FILTER (WHERE fate = 'lemma' AND pair IS NULL AND def IS NULL) AS form_misses, "
            "count(DISTINCT form) FILTER (WHERE fate = 'lemma' AND pair IS NULL AND def IS NULL) AS unknown_forms FROM lemmas",
        ),
        "removed_tokens": with_(
            LEMMAS, "SELECT pos AS \"Pos\", form AS \"Text\", count(*) AS n FROM lemmas WHERE fate = 'removed' GROUP BY ALL"
        ),
        "unknown_forms": with_(
            LEMMAS, "SELECT DISTINCT form FROM lemmas WHERE fate = 'lemma' AND pair IS NULL AND def IS NULL"
        ),
        "train_split": with_(PARAS, f"SELECT doc_id, para_no FROM paras WHERE {SPLIT} < 800"),
        "heldout_split": with_(PARAS, f"SELECT doc_id, para_no FROM paras WHERE {SPLIT} >= 800"),
        "topic_map_wide": with_(
            DIMS, wide("tmap", "doc_id", "id", 5, ("topic", "topic_index"), ("weight", "topic_weight"))
        ),
        "topic_map_long": with_(
            DIMS, f"SELECT doc_id AS id, rank, topic, {r6('weight')} AS weight FROM tmap WHERE rank <= 5"
        ),
        "topic_words_wide": with_(
            NEAR_WORDS, wide("near", "topic", "topic_id", 10, ("term", "term_name"), ("weight", "term_weight"))
        ),
        "topic_merge": with_(
            MERGED,
            f"SELECT doc_id, topic, label, rank, {r6('weight')} AS weight, {r6('top_weight')} AS top_weight FROM merged",
        ),
        "topic_share": with_(MERGED, "SELECT doc_id, topic, share FROM shares"),
        "topic_positions": with_(
            MERGED,
            "SELECT doc_id, CASE WHEN topic = -1 THEN 10 ELSE topic END AS topic, label, "
            "(sum(share) OVER w)::BIGINT - share AS start, (sum(share) OVER w)::BIGINT AS stop FROM shares "
            "WINDOW w AS (PARTITION BY doc_id ORDER BY topic ROWS UNBOUNDED PRECEDING)",
        ),
        "topic_counts": with_(
            DIMS
            + """,
firsts AS (SELECT doc_id, weight AS top_weight FROM tmap WHERE rank = 1),
stops AS (
  SELECT doc_id, coalesce(min(rank) FILTER (WHERE weight < 0.1 * top_weight), 5) AS stop
  FROM tmap JOIN firsts USING (doc_id) WHERE rank <= 4 GROUP BY doc_id
)""",
            "SELECT topic, count(*) AS n_docs FROM tmap JOIN stops USING (doc_id) WHERE rank <= 4 AND rank < stop GROUP BY topic",
        ),
        "docfreq_histogram": with_(
            FREQS,
            "SELECT bin, n_terms, (bin - 1) * 1.25::DOUBLE AS low FROM (SELECT least(floor(df / 1.25) + 1, 20)::INT AS bin, "
            "count(*) AS n_terms FROM freq WHERE df BETWEEN 0 AND 25 GROUP BY 1)",
        ),
        "topic_captions": with_(
            NEAR_WORDS
            + f""",
labels17 AS (SELECT * FROM (VALUES {LABELS}) AS v(raw_topic, merged, label)),
first_raw AS (SELECT merged, min(raw_topic) AS raw_topic, min_by(label, raw_topic) AS label FROM labels17 WHERE merged <> -1 GROUP BY merged)""",
            "SELECT merged AS topic, '[' || max(label) || '] ' || string_agg(term, ' ' ORDER BY rank) AS caption "
            "FROM near JOIN first_raw ON raw_topic = near.topic WHERE rank <= 5 GROUP BY merged",
        ),
        "best_k": with_(
            MEASURES,
            f"""SELECT 'embedding' AS model, 'word2vec' AS metric, k, {r6("word2vec")} AS value FROM
  (SELECT * FROM by_rank ORDER BY word2vec DESC, k LIMIT 1)
UNION ALL SELECT 'embedding', 'wsse', k, {r6("wsse")} FROM (SELECT * FROM by_rank ORDER BY wsse, k LIMIT 1)""",
        ),
        "measures_wide": with_(
            MEASURES, f"SELECT k AS topic, {r6('wsse')} AS wsse, {r6('word2vec')} AS word2vec FROM by_rank"
        ),
    }
    sql["tfidf_ntc_vectors"] = sql["tfidf_ntc"].replace("para_no, term,", "para_no, term_id,", 1)
    sql["stopword_filter_join"] = sql["term_freq"]
    sql["heldout_by_difference"] = sql["heldout_split"]
    unknown = (
        VECTORS
        + r""",
unknown AS (
  SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(words) AS w FROM paras)
  WHERE NOT regexp_full_match(lower(w), '[0-9]+') AND lower(w) NOT IN (SELECT word FROM vecs)
)"""
    )
    long_topics = [
        "SELECT * FROM (" + with_(
            COOC.replace("rank <= 10", f"rank <= {n}").replace(
                "/ (10 * 9) AS umass FROM cooc",
                "/ (any_value(m) * (any_value(m) - 1)) AS umass, count(*) FILTER (WHERE n_wj = 0) AS null_pairs "
                "FROM cooc JOIN (SELECT topic, count(*) AS m FROM topics GROUP BY topic) USING (topic)",
            ),
            f"SELECT {n} AS size, topic, {r6('umass')} AS umass, null_pairs FROM umass",
        ) + ")"
        for n in (12, 70)
    ]
    sql["umass_long_topics"] = " UNION ALL ".join(long_topics)
    sql["topic_merge_unlabelled"] = (
        sql["topic_merge"]
        .replace("merged AS topic, label, weight,", f"coalesce(merged, {UNKNOWN}) AS topic, label, weight,")
        .replace("PARTITION BY doc_id, merged ORDER", f"PARTITION BY doc_id, coalesce(merged, {UNKNOWN}) ORDER")
        .replace("FROM tmap JOIN labels17 ON raw_topic = tmap.topic", "FROM tmap LEFT JOIN labels17 ON raw_topic = tmap.topic + 12")
    )
    # Fits: what must hold for each document or topic, with the documents, words and weights taken from the tables.
    docs = "(SELECT DISTINCT doc_id, para_no FROM weighed)"
    sql["lda_mixtures"] = with_(WEIGHTS, f"SELECT doc_id, para_no, 5 AS n_topics, 1.0::DOUBLE AS total, true AS falling FROM {docs}")
    sql["lsa_document_shares"] = with_(WEIGHTS, f"SELECT doc_id, para_no, 10 AS n_topics, true AS falling, true AS within FROM {docs}")
    ranks = (
        "SELECT topic::INT AS topic, n AS n_words, n AS n_ranks, n AS last, n AS n_known, true AS falling "
        "FROM range(5) AS t(topic), (SELECT least(count(*), 10) AS n FROM vocab)"
    )
    for name in ("lda_word_ranks", "tfidf_cluster_ranks", "lsa_word_ranks"):
        sql[name] = with_(VOCAB, ranks)
    sql["lda_heldout_tokens"] = with_(
        WEIGHTS, f"SELECT k, sum(tf)::BIGINT AS tokens FROM weighed, (VALUES (2), (4)) AS v(k) WHERE {SPLIT} >= 800 GROUP BY k"
    )
    sql["svd_invariants"] = with_(
        WEIGHTS,
        f"SELECT concept::INT AS concept, 1.0::DOUBLE AS u_size, 0.0::DOUBLE AS v_defect, energy, true AS within FROM range(10) AS t(concept), "
        f"(SELECT {r6('sum((idf * tf / total) ** 2)')} AS energy FROM weighed)",
    )
    # The rank of the weights: their different rows (equal paragraphs repeat a row), at most 200 and the terms.
    sql["lsa_uncut_invariants"] = with_(
        WEIGHTS,
        f"SELECT concept::INT AS concept, 0.0::DOUBLE AS v_defect, true AS u_near, true AS falling, energy, true AS within "
        f"FROM (SELECT {r6('sum((idf * tf / total) ** 2)')} AS energy, count(DISTINCT term) AS n_terms FROM weighed), "
        f"(SELECT least(200, count(DISTINCT v)) AS n_rows FROM (SELECT list((term, round(idf * tf / total, 12)) ORDER BY term) AS v FROM weighed GROUP BY doc_id, para_no)), "
        f"range(200) AS t(concept) WHERE concept < least(n_rows, n_terms)",
    )
    theta = f"({_digamma('gamma')} - {_digamma('gamma * k')})"
    sql["lda_heldout_bound"] = with_(
        WEIGHTS
        + f""",
tr AS (SELECT coalesce(lang, '') AS topic, term, tf FROM weighed WHERE {SPLIT} < 800),
hd AS (SELECT doc_id, para_no, term, tf FROM weighed WHERE {SPLIT} >= 800),
tp AS (SELECT DISTINCT topic FROM tr),
kk AS (SELECT count(*) AS k FROM tp),
lam AS (SELECT v.term, t.topic, 0.1 + coalesce(sum(tr.tf), 0) AS lam FROM vocab v CROSS JOIN tp t LEFT JOIN tr ON tr.term = v.term AND tr.topic = t.topic GROUP BY v.term, t.topic),
tot AS (SELECT topic, sum(lam) AS s FROM lam GROUP BY topic),
el AS (SELECT term, ln(sum(exp({_digamma('lam')} - {_digamma('s')}))) AS lse FROM lam JOIN tot USING (topic) GROUP BY term),
doc AS (SELECT doc_id, para_no, sum(tf) AS tokens, sum(tf * lse) AS fit FROM hd JOIN el USING (term) GROUP BY doc_id, para_no),
g AS (SELECT doc_id, para_no, tokens, fit, k, 0.5 + tokens / k AS gamma FROM doc, kk)""",
        f"SELECT doc_id, para_no, tokens::BIGINT AS tokens, round(tokens * {theta} + fit + k * ((0.5 - gamma) * {theta} + {_log_gamma('gamma')} - {_log_gamma('0.5')}) "
        f"+ {_log_gamma('k * 0.5')} - {_log_gamma('gamma * k')}, 3) + 0.0 AS bound FROM g",
    )
    sql["kmeans_stationary"] = (
        "SELECT cluster::INT AS cluster, true AS stationary, n AS n_rows FROM range(10) AS t(cluster), "
        "(SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"
    )
    sql["embed_cluster_members"] = with_(WEIGHTS, f"SELECT count(*) AS n_docs, 5 AS n_clusters, 0 AS n_elsewhere FROM {docs}")
    sql["oov_words"] = with_(unknown, "SELECT word FROM unknown")
    sql["oov_count"] = with_(unknown, "SELECT count(*) AS n_unknown FROM unknown")
    return sql
