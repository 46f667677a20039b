"""The deterministic queries of the catalogue as SQL over the same tables."""

from __future__ import annotations

from topicloom.functions.stopwords import ENGLISH
from topicloom.settings import (
    COLOURS,
    KMEANS_ITERATIONS,
    LANDMARK_AXES,
    LANDMARK_MEAN_SQUARES,
    MIN_DF,
    NEIGHBOURS,
    PAIR_THRESHOLD,
    REPORT_DATES,
    Y_RANGE,
)


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(_quote(w) for w in ENGLISH) + "]"
DATE_LIST = ", ".join(f"TIMESTAMP '{d.replace('T', ' ')}'" for d in REPORT_DATES)
COLOUR_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COLOURS))

LETTERS = "regexp_extract_all(lower(text), '[a-z_''-]+')"
WORD_CHARS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?')"
WORDS = (
    r"regexp_extract_all(regexp_replace(lower(text), '(n''t|''(?:s|m|d|ll|re|ve)\b)', ' \1', 'g'),"
    r" 'n''t|''(?:s|m|d|ll|re|ve)\b|[\p{L}\p{N}_]+(?:[-''.][\p{L}\p{N}_]+|,[0-9]+)*"
    r"|[^\s\p{L}\p{N}_]')"
)


def _keep(tokens: str) -> str:
    return (
        f"list_filter({tokens}, lambda t: regexp_matches(t, '[a-zA-Z]')"
        f" AND NOT list_contains({STOP_LIST}, t))"
    )


def _s_strip(t: str) -> str:
    return (
        f"CASE WHEN {t} LIKE '%ies' AND NOT ({t} LIKE '%eies' OR {t} LIKE '%aies')"
        f" THEN left({t}, length({t}) - 3) || 'y'"
        f" WHEN {t} LIKE '%es' AND NOT ({t} LIKE '%aes' OR {t} LIKE '%ees' OR {t} LIKE '%oes')"
        f" THEN left({t}, length({t}) - 1)"
        f" WHEN {t} LIKE '%s' AND NOT ({t} LIKE '%us' OR {t} LIKE '%ss')"
        f" THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def _stemmed(table: str, key: str) -> str:
    return (
        f"SELECT *, list_transform(words, lambda t: {_s_strip('t')}) AS stems"
        f" FROM (SELECT {key}, {_keep(LETTERS)} AS words FROM {table})"
    )


def _grams(table: str, key: str) -> str:
    return f"""
    SELECT {key}, unnest(stems) AS term FROM {table}
    UNION ALL
    SELECT {key}, unnest(list_transform(range(1, len(stems)),
        lambda i: stems[i] || ' ' || stems[i + 1])) FROM {table}
    UNION ALL
    SELECT {key}, unnest(list_transform(range(1, len(stems) - 1),
        lambda i: stems[i] || ' ' || stems[i + 1] || ' ' || stems[i + 2])) FROM {table}"""


STEMMED = f"stemmed AS ({_stemmed('documents', 'doc_id')})"
OCCURRENCES = """occ AS (
    SELECT doc_id, unnest(words) AS word, unnest(stems) AS stem,
        unnest(range(0, len(words))) AS pos FROM stemmed)"""
FIRST_WORDS = """firsts AS (
    SELECT stem, word FROM (
        SELECT stem, word, row_number() OVER (PARTITION BY stem ORDER BY doc_id, pos) AS r
        FROM occ) WHERE r = 1)"""
FREQ = f"""grams AS ({_grams("stemmed", "doc_id")}),
n AS (SELECT count(*) AS n FROM documents),
freq AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM grams GROUP BY term)"""
VOCAB = """vocab AS (
    SELECT term, df, total, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf
    FROM freq, n WHERE df >= 0.001 * n AND df <= 0.8 * n
    ORDER BY total DESC, term LIMIT 20000)"""


def _weights(grams: str, key: str, power: int = 1) -> str:
    return f"""counted AS (
    SELECT {key}, term, count(*) AS tf, any_value(idf) AS idf
    FROM {grams} JOIN vocab USING (term) GROUP BY {key}, term),
weights AS (
    SELECT {key}, term, tf, tf * pow(idf, {power})
        / sqrt(sum(pow(tf * pow(idf, {power}), 2)) OVER (PARTITION BY {key})) AS weight
    FROM counted)"""


BASE = f"WITH {STEMMED}, {FREQ}, {VOCAB}"
WEIGHTED = f"{BASE}, {_weights('grams', 'doc_id')}"
CLUSTERS = """clusters AS (
    SELECT doc_id, text, source, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS cluster
    FROM documents)"""
CENTERS = """sizes AS (SELECT cluster, count(*) AS size FROM clusters GROUP BY cluster),
centers AS (
    SELECT cluster, term, sum(weight) / any_value(size) AS weight
    FROM weights JOIN clusters USING (doc_id) JOIN sizes USING (cluster)
    GROUP BY cluster, term)"""
TOP = """top AS (
    SELECT * FROM (
        SELECT cluster, term, weight, CAST(row_number() OVER (
            PARTITION BY cluster ORDER BY round(weight, 12) DESC, term) AS INTEGER) AS rank
        FROM centers) WHERE rank <= 6)"""
SHOWN = """shown AS (
    SELECT term, string_agg(firsts.word, ' ' ORDER BY part) AS word
    FROM (SELECT term, unnest(string_split(term, ' ')) AS stem,
              unnest(range(0, len(string_split(term, ' ')))) AS part FROM wanted)
    JOIN firsts USING (stem) GROUP BY term)"""
MISSING = """frame AS (
    SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic,
        CASE WHEN quality = 0 THEN NULL ELSE n_chars::DOUBLE END AS x
    FROM documents LEFT JOIN labels USING (doc_id))"""
VECTORS = """vecs AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""
MEANS = """dims AS (
    SELECT vec_id, label, unnest(v) AS value, CAST(unnest(range(0, len(v))) AS INTEGER) AS dim
    FROM vecs),
means AS (SELECT label, dim, avg(value) AS mean FROM dims GROUP BY label, dim),
mids AS (SELECT label, list(mean ORDER BY dim) AS m FROM means GROUP BY label)"""
# Representatives of equal vectors and the similarity of all their pairs.
PAIRS = f"""signed AS (
    SELECT doc_id, string_agg(term || '=' || tf, ';' ORDER BY term) AS signature
    FROM weights GROUP BY doc_id),
groups AS (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY signature) AS rep,
        count(*) OVER (PARTITION BY signature) AS members FROM signed),
reps AS (
    SELECT w.doc_id AS id, term, weight FROM weights w
    JOIN groups g ON g.doc_id = w.doc_id AND g.doc_id = g.rep),
pairs AS (
    SELECT a.id AS i, b.id AS j, 1 - sum(a.weight * b.weight) AS distance
    FROM reps a JOIN reps b ON a.term = b.term AND a.id < b.id
    GROUP BY a.id, b.id HAVING sum(a.weight * b.weight) >= {PAIR_THRESHOLD} - 1e-9)"""


def _tokens(expression: str) -> str:
    return f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, {expression} AS t FROM documents)"""


def _schema_rows() -> str:
    types = {
        "doc_id": "bigint",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "bigint",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, count({c}) AS n_values FROM documents"
        for c, t in types.items()
    )


def _describe_rows() -> str:
    rows = []
    for c, numeric in (
        ("doc_id", True),
        ("text", False),
        ("lang", False),
        ("source", False),
        ("n_chars", True),
    ):
        mean = f"round(avg({c}), 6)" if numeric else "CAST(NULL AS DOUBLE)"
        sd = f"round(stddev_samp({c}), 6)" if numeric else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT '{c}' AS column_name, count({c}) AS n, {mean} AS mean, {sd} AS stddev,"
            f" CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM documents"
        )
    return " UNION ALL ".join(rows)


# Letters and marks beyond ASCII, with what is left of them: written out, so that
# the SQL shares no rule with the query.
FOLDED = {
    "a": "áàâãåä", "A": "ÁÀÂÃÅÄ", "c": "ç", "C": "Ç", "e": "éèêë", "E": "ÉÈÊË", "i": "íìîï", "I": "ÍÌÎÏ",
    "n": "ñ", "N": "Ñ", "o": "óòôõö", "O": "ÓÒÔÕÖ", "u": "úùûü", "U": "ÚÙÛÜ", "y": "ýÿ", "Y": "Ý",
    " ": "\u00a0\u2002\u2003\u2009\u3000", "...": "…", "TM": "™", "No": "№", "1": "¹", "2": "²", "3": "³",
    "": "ßæøœÆØŒ–—‘’“”«»€£",
}


def _folded() -> str:
    column = "text"
    for plain, chars in FOLDED.items():
        for char in chars:
            column = f"replace({column}, '{char}', '{plain}')"
    return f"SELECT doc_id, {column} AS folded FROM documents"


def _landmarks() -> str:
    values = ", ".join(
        f"({i + 1}, {x}, {y}, {m})"
        for i, (x, y, m) in enumerate(zip(*LANDMARK_AXES, LANDMARK_MEAN_SQUARES, strict=True))
    )
    return f"""WITH {VECTORS}, map(r, ax, ay, ms) AS (VALUES {values}),
        marks AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, v AS m FROM vecs)
        SELECT vec_id, round(sum(ax * (pow(list_distance(v, m), 2) - ms)) * -0.5, 6) + 0.0 AS x,
            round(sum(ay * (pow(list_distance(v, m), 2) - ms)) * -0.5, 6) + 0.0 AS y
        FROM vecs, marks JOIN map USING (r) GROUP BY vec_id"""


def _kmeans() -> str:
    steps = [
        f"WITH {VECTORS}",
        """c0 AS (SELECT label AS cluster, arg_min(v, vec_id) AS m FROM vecs GROUP BY label)""",
    ]
    nearest = """SELECT vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster FROM (
        SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, m),
            lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vecs, {c}) GROUP BY vec_id"""
    for i in range(KMEANS_ITERATIONS):
        steps.append(f"a{i} AS ({nearest.format(c=f'c{i}')})")
        steps.append(
            f"""c{i + 1} AS (SELECT cluster, list(mean ORDER BY dim) AS m FROM (
            SELECT cluster, dim, avg(value) AS mean FROM (
                SELECT cluster, unnest(v) AS value, unnest(range(0, len(v))) AS dim FROM a{i})
            GROUP BY cluster, dim) GROUP BY cluster)"""
        )
    last = nearest.format(c=f"c{KMEANS_ITERATIONS}")
    return (
        ",\n".join(steps)
        + f"\nSELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM ({last})"
    )


def oracle_sql() -> dict[str, str]:
    return {
        # sources and sinks
        "scan_table": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "scan_query": f"""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
            WHERE o_orderdate IN ({DATE_LIST})""",
        "view_select": "SELECT doc_id, lang, n_chars FROM documents",
        "dim_from_local": f"""SELECT label, CASE label % {len(COLOURS)} {COLOUR_CASE} END AS colour,
            count(*) AS n FROM embeddings GROUP BY label""",
        "coords_roundtrip": """SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS x,
            round(embedding[2]::DOUBLE, 6) + 0.0 AS y FROM embeddings""",
        "write_clusters": f"WITH {CLUSTERS} SELECT doc_id, source, cluster FROM clusters",
        # projection, filter, profiling
        "project_columns": "SELECT doc_id, lang, source, n_chars FROM documents",
        "filter_report_dates": f"""SELECT o_orderkey, o_custkey FROM orders
            WHERE o_orderdate IN ({DATE_LIST})""",
        "limit_ordered": """SELECT doc_id, n_chars FROM documents
            ORDER BY n_chars DESC, doc_id LIMIT 10""",
        "schema_table": _schema_rows(),
        "row_count": "SELECT count(*) AS n FROM documents",
        "describe_columns": _describe_rows(),
        "normalize_missing": f"WITH {MISSING} SELECT doc_id, quality, toxic, x FROM frame",
        "missing_counts": f"WITH {MISSING} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM frame"
            for c in ("doc_id", "quality", "toxic", "x")
        ),
        "drop_empty_columns": f"WITH {MISSING} SELECT doc_id, quality, toxic, x FROM frame",
        "drop_incomplete_rows": f"""WITH {MISSING} SELECT doc_id, quality, toxic, x FROM frame
            WHERE quality IS NOT NULL AND toxic IS NOT NULL AND x IS NOT NULL""",
        # joins
        "attach_tokens": f"""SELECT doc_id, source, CAST(len(t) AS INTEGER) AS n_tokens,
            array_to_string(t, ' ') AS tokens
            FROM (SELECT doc_id, source, {_keep(LETTERS)} AS t FROM documents)""",
        "attach_cluster": f"""WITH {CLUSTERS}
            SELECT doc_id, source, length(text) AS n_chars, cluster FROM clusters""",
        "stem_to_word": f"""{BASE}, {OCCURRENCES}, {FIRST_WORDS},
            wanted AS (SELECT stem AS term FROM firsts), {SHOWN} SELECT term, word FROM shown""",
        # text
        "tokenize_words": _tokens(WORDS),
        "tokenize_regex": _tokens(LETTERS),
        "tokenize_wordchars": _tokens(WORD_CHARS),
        "filter_alpha_tokens": _tokens(
            f"list_filter({WORDS}, lambda t: regexp_matches(t, '[a-zA-Z]'))"
        ),
        "remove_stopwords": _tokens(_keep(LETTERS)),
        "fold_accents": _folded(),
        "stem_vocabulary": f"""SELECT token, {_s_strip("token")} AS stem, count(*) AS n
            FROM (SELECT unnest({_keep(LETTERS)}) AS token FROM documents) GROUP BY token""",
        "stop_words_after_stems": f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens,
            array_to_string(t, ' ') AS tokens FROM (
            SELECT doc_id, list_filter(list_transform(list_filter({WORDS},
                    lambda t: regexp_matches(t, '[a-zA-Z]')), lambda t: {_s_strip("t")}),
                lambda t: NOT list_contains({STOP_LIST}, t)) AS t
            FROM (SELECT doc_id, folded AS text FROM ({_folded()})))""",
        "explode_tokens": f"""SELECT doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos,
            unnest(t) AS token FROM (SELECT doc_id, {_keep(LETTERS)} AS t FROM documents)""",
        "ngrams": f"""WITH {STEMMED} SELECT doc_id, CAST(len(g) AS INTEGER) AS n_terms,
            array_to_string(g, '|') AS terms FROM (
            SELECT doc_id, list_concat(stems,
                list_transform(range(1, len(stems)), lambda i: stems[i] || ' ' || stems[i + 1]),
                list_transform(range(1, len(stems) - 1),
                    lambda i: stems[i] || ' ' || stems[i + 1] || ' ' || stems[i + 2])) AS g
            FROM stemmed)""",
        "cluster_names": f"""{WEIGHTED}, {CLUSTERS}, {CENTERS}, {TOP}, {OCCURRENCES}, {FIRST_WORDS},
            wanted AS (SELECT DISTINCT term FROM top), {SHOWN}
            SELECT cluster, string_agg(word, ',' ORDER BY rank) AS name
            FROM top JOIN shown USING (term) GROUP BY cluster""",
        # vocabulary and weights
        "vocab_frame": f"""WITH {STEMMED}, {OCCURRENCES} SELECT stem, word, n, first_doc,
            CAST(first_pos AS INTEGER) AS first_pos FROM (
            SELECT stem, word, count(*) OVER w AS n, doc_id AS first_doc, pos AS first_pos,
                row_number() OVER (PARTITION BY stem, word ORDER BY doc_id, pos) AS r
            FROM occ WINDOW w AS (PARTITION BY stem, word)) WHERE r = 1""",
        "vocab_size": f"""WITH {STEMMED}, {OCCURRENCES} SELECT count(*) AS n_items,
            count(DISTINCT (stem, word)) AS n_words, count(DISTINCT stem) AS n_stems FROM occ""",
        "term_counts": f"""WITH {STEMMED} SELECT doc_id, term, count(*) AS tf
            FROM (SELECT doc_id, unnest(stems) AS term FROM stemmed) GROUP BY doc_id, term""",
        "doc_frequency": f"""WITH {STEMMED}, {FREQ} SELECT term, df, total FROM freq, n
            WHERE df >= {MIN_DF} * n AND df <= 0.8 * n""",
        "vocab_cap": f"{BASE} SELECT term, df, total FROM vocab",
        "idf_smooth": f"{BASE} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "tfidf": f"{WEIGHTED} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights",
        "tfidf_double": f"""{BASE}, {_weights("grams", "doc_id", 2)}
            SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights""",
        "tfidf_score_new": f"""{BASE}, fresh AS ({_stemmed("benchmark", "item_id")}),
            news AS ({_grams("fresh", "item_id")}), {_weights("news", "item_id")}
            SELECT item_id, term, tf, round(weight, 6) AS weight FROM weights""",
        "feature_names": f"""{BASE} SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER)
            AS idx, term FROM vocab""",
        # embeddings
        "mean_vector": f"""WITH {VECTORS}, {MEANS}
            SELECT label, dim, round(mean, 6) + 0.0 AS mean FROM means""",
        "nearest_vectors": f"""WITH {VECTORS}, q AS (SELECT v AS qv FROM vecs
                WHERE vec_id = (SELECT min(vec_id) FROM vecs))
            SELECT vec_id, round(list_cosine_similarity(v, qv), 6) + 0.0 AS similarity
            FROM vecs, q ORDER BY list_cosine_similarity(v, qv) DESC, vec_id LIMIT 10""",
        "string_index": """SELECT source AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS idx
            FROM documents GROUP BY source""",
        "cluster_onehot": "SELECT doc_id, "
        + ", ".join(
            f"CAST(lang = '{lang}' AS INTEGER) AS {lang}" for lang in ("de", "en", "es", "fr")
        )
        + " FROM documents",
        "assemble_vectors": f"""WITH {VECTORS}, labs AS (SELECT DISTINCT label AS l FROM vecs),
            flags AS (SELECT list(l ORDER BY l) AS ls FROM labs)
            SELECT vec_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS dim,
                round(unnest(a), 6) + 0.0 AS value
            FROM (SELECT vec_id, list_concat(
                list_transform(ls, lambda x: CAST(x = label AS INTEGER)::DOUBLE), v) AS a
                FROM vecs, flags)""",
        # clusters
        "project_on_axes": f"""WITH {VECTORS}, {MEANS},
            axes AS (SELECT m, row_number() OVER (ORDER BY label) AS r FROM mids)
            SELECT vec_id, round(max(CASE WHEN r = 1 THEN list_dot_product(v, m) END), 6) + 0.0 AS x,
                round(max(CASE WHEN r = 2 THEN list_dot_product(v, m) END), 6) + 0.0 AS y
            FROM vecs, axes GROUP BY vec_id""",
        "place_by_landmarks": _landmarks(),
        "kmeans_fixed_init": _kmeans(),
        "center_distances": f"""WITH {VECTORS}, {MEANS} SELECT vec_id, label AS cluster,
            round(list_distance(v, m), 6) AS distance
            FROM (SELECT vec_id, v FROM vecs), mids""",
        "cluster_centers": f"""{WEIGHTED}, {CLUSTERS}, {CENTERS}
            SELECT cluster, term, round(weight, 6) + 0.0 AS weight FROM centers""",
        "silhouette": f"""WITH {VECTORS}, d AS (
                SELECT a.vec_id, a.label AS own, b.label AS other,
                    sum(list_sum(list_transform(list_zip(a.v, b.v),
                        lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS total,
                    count(*) AS n
                FROM vecs a, vecs b GROUP BY a.vec_id, a.label, b.label),
            ab AS (SELECT vec_id,
                max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a,
                min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY vec_id)
            SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab""",
        "cluster_sizes": f"""WITH {CLUSTERS}
            SELECT cluster, count(doc_id) AS size FROM clusters GROUP BY cluster""",
        "top_terms": f"""{WEIGHTED}, {CLUSTERS}, {CENTERS}, {TOP}
            SELECT cluster, rank, term, round(weight, 6) AS weight FROM top""",
        "nearest_to_center": f"""WITH {VECTORS}, {MEANS}, scored AS (
                SELECT label AS cluster, vec_id, list_cosine_similarity(v, m) AS similarity
                FROM (SELECT vec_id, v FROM vecs), mids)
            SELECT cluster, rank, vec_id, round(similarity, 6) + 0.0 AS similarity FROM (
                SELECT *, CAST(row_number() OVER (PARTITION BY cluster
                    ORDER BY round(similarity, 12) DESC, vec_id) AS INTEGER) AS rank FROM scored)
            WHERE rank <= 6""",
        "cluster_titles": f"""WITH {CLUSTERS} SELECT cluster, doc_id,
            split_part(text, chr(10), 1) AS title FROM clusters""",
        # similarity and layout
        "cosine_pairs": f"""{WEIGHTED}, {PAIRS}
            SELECT i, j, round(distance, 6) + 0.0 AS distance, a.members AS n_i, b.members AS n_j
            FROM pairs JOIN groups a ON a.doc_id = i JOIN groups b ON b.doc_id = j
            UNION ALL
            SELECT doc_id, doc_id, 0.0::DOUBLE, members, members FROM groups
            WHERE doc_id = rep AND members > 1""",
        "vector_groups": f"{WEIGHTED}, {PAIRS} SELECT doc_id, rep FROM groups",
        "similar_items": f"""{WEIGHTED}, near AS (
                SELECT a.doc_id, b.doc_id AS item,
                    round(1 - sum(a.weight * b.weight), 9) AS distance
                FROM weights a JOIN weights b ON a.term = b.term AND a.doc_id <> b.doc_id
                GROUP BY a.doc_id, b.doc_id
                HAVING sum(a.weight * b.weight) >= {PAIR_THRESHOLD} - 1e-9)
            SELECT doc_id, CAST(rank AS INTEGER) AS rank, item,
                round(distance, 6) + 0.0 AS distance FROM (
                SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, item) AS rank
                FROM near) WHERE rank <= {NEIGHBOURS}""",
        "nearest_items": f"""{WEIGHTED}, near AS (
                SELECT a.doc_id, b.doc_id AS item,
                    round(1 - sum(a.weight * b.weight), 9) AS distance
                FROM weights a JOIN weights b ON a.term = b.term AND a.doc_id <> b.doc_id
                GROUP BY a.doc_id, b.doc_id)
            SELECT doc_id, CAST(rank AS INTEGER) AS rank, item,
                round(distance, 6) + 0.0 AS distance FROM (
                SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, item) AS rank
                FROM near) WHERE rank <= {NEIGHBOURS}""",
        "term_similarity": f"""WITH {VECTORS}, {MEANS}
            SELECT a.dim AS i, b.dim AS j, round(sum(a.value * b.value)
                / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) + 0.0 AS similarity
            FROM dims a JOIN dims b ON a.vec_id = b.vec_id AND a.dim < b.dim
            GROUP BY a.dim, b.dim""",
        "plot_frame": f"""SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE * 10, 6) + 0.0 AS x,
            round(embedding[2]::DOUBLE * 10, 6) + 0.0 AS y, label,
            split_part(text, chr(10), 1) AS title, 'topic ' || label AS name,
            CASE label % {len(COLOURS)} {COLOUR_CASE} END AS colour
            FROM embeddings JOIN documents ON doc_id = vec_id
            WHERE embedding[2]::DOUBLE * 10 BETWEEN {Y_RANGE[0]} AND {Y_RANGE[1]}""",
        "matrix_shape": "SELECT count(*) AS n_rows, max(len(embedding)) AS n_cols FROM embeddings",
    }
