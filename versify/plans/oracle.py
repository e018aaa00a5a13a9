"""DuckDB twins of the registered queries (the correctness gate at sf0.01).

Tables are the pre-registered views of the driver.  The verse view and the
line-level rules are restated relationally (unnest + windows) where the Spark
side works on arrays, so the two implementations check each other.
"""

from __future__ import annotations

from versify.functions import structure as S
from versify.functions import text as X
from versify.plans import duck as D
from versify.plans import files
from versify.plans.duck import NL, q, strip

ORACLE: dict[str, str] = dict(files.ORACLE)


def sql(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn

    return deco


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def eval_text(e: str) -> str:
    return f"replace({strip(f'replace(replace({e}, {q(chr(60) + "SONNET>")}, {q("")}), {q("<END>")}, {q("")})')}, '<NEWLINE>', {NL})"


def eval_lines(t: str) -> str:
    return (
        f"list_transform(list_filter(string_split({t}, {NL}), lambda l: {strip('l')} <> '' AND NOT starts_with(l, '<')), "
        f"lambda l: {strip('l')})"
    )


def format_structure(lines: str) -> str:
    def b(a, n):
        return f"array_to_string(list_slice({lines}, {a}, {a + n - 1}), {NL})"

    sonnet = f"{b(1, 4)} || {NL} || {NL} || {b(5, 4)} || {NL} || {NL} || {b(9, 3)} || {NL} || {NL} || {b(12, 3)}"
    return (
        f"(CASE WHEN len({lines}) = 14 THEN {sonnet} "
        f"WHEN len({lines}) = 17 THEN {sonnet} || {NL} || {NL} || {b(15, 3)} "
        f"ELSE array_to_string({lines}, {NL}) END)"
    )


def signature(lst: str) -> str:
    return (
        f"array_to_string(list_transform({lst}, lambda e: chr(CAST(64 + len(list_distinct("
        f"list_slice({lst}, 1, list_position({lst}, e)))) AS INTEGER))), '')"
    )


def clean_text(e: str) -> str:
    out = f"translate({e}, {q(X.TRANSLATE_SRC)}, {q(X.TRANSLATE_DST)})"
    for k, v in X.MULTI_REPLACE:
        out = f"replace({out}, {q(k)}, {q(v)})"
    return f"regexp_replace({out}, '\\(\\d+\\)', '', 'g')"


def block_counts(e: str) -> str:
    return (
        f"list_transform(list_filter(string_split_regex({strip(e)}, '\\n\\s*\\n'), lambda s: {strip('s')} <> ''), "
        f"lambda s: len(string_split(s, {NL})))"
    )


def stanza_lengths(t: str) -> str:
    stanzas = f"list_filter(list_transform(string_split({t}, {NL} || {NL}), lambda s: {strip('s')}), lambda s: s <> '')"
    lens = (
        f"list_transform({stanzas}, lambda s: len(list_filter(string_split(s, {NL}), "
        f"lambda l: {strip('l')} <> '' AND NOT starts_with(l, '<'))))"
    )
    return f"list_filter({lens}, lambda n: n > 0)"


WITH_VERSE = "WITH " + D.VERSE_CTE
WITH_LINES = "WITH " + D.VERSE_LINES_CTE


# ---------------------------------------------------------------- 1 text
@sql("clean_text")
def _():
    c = clean_text("text")
    return f"SELECT doc_id, CAST(length({c}) AS BIGINT) AS clean_chars, md5({c}) AS clean_md5 FROM documents"


@sql("clean_verse")
def _():
    t = f"replace(replace(text, chr(13) || chr(10), ' '), chr(10) || chr(13), ' ')"
    t = f"regexp_replace({t}, '\\n\\s{{4}}', ' ', 'g')"
    t = f"regexp_replace({t}, '\\(\\d{{1,2}}\\)', '', 'g')"
    c = f"array_to_string(list_transform(string_split({t}, {NL}), lambda l: {strip('l')}), {NL})"
    return f"SELECT doc_id, CAST(length(c) AS BIGINT) AS verse_chars, md5(c) AS verse_md5 FROM (SELECT doc_id, {c} AS c FROM documents)"


@sql("layout")
def _():
    lines = eval_lines("text")
    return f"""{WITH_VERSE},
    a AS (SELECT doc_id, poem_no, {lines} AS lines FROM verse),
    b AS (SELECT doc_id, poem_no, lines, {format_structure('lines')} AS laid FROM a)
    SELECT doc_id, poem_no, CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(string_split(laid, {NL} || {NL})) AS BIGINT) AS n_blocks, md5(laid) AS layout_md5 FROM b"""


@sql("fix_merged_lines")
def _():
    pat = "'^(.*?[:;,.?!])\\s+[A-Za-z]'"
    head = f"regexp_extract(l, {pat}, 1)"
    fix = (
        f"flatten(list_transform(lines, lambda l: CASE WHEN length(l) > 65 AND regexp_matches(l, {pat}) "
        f"THEN [{strip(head)}, {strip(f'substring(l, length({head}) + 1)')}] ELSE [l] END))"
    )
    return f"""WITH a AS (SELECT doc_id, list_transform(list_filter(string_split(text, {NL}), lambda l: {strip('l')} <> ''),
                                             lambda l: {strip('l')}) AS lines FROM documents),
    b AS (SELECT doc_id, {fix} AS fixed FROM a),
    c AS (SELECT doc_id, {format_structure('fixed')} AS out FROM b)
    SELECT doc_id, CAST(len(string_split(out, {NL})) AS BIGINT) AS n_rows, md5(out) AS fixed_md5 FROM c"""


def markup(e: str, stem: str | None) -> str:
    t = f"replace({clean_text(strip(e))}, {NL} || {NL}, {NL} || {NL} || '<STANZA>' || {NL} || {NL})"
    if stem is not None:
        t = f"'<TITLE>' || {stem} || '</TITLE>' || {NL} || {NL} || {t}"
    return f"'<SONNET>' || {NL} || {t} || {NL} || '<END>'"


@sql("markup")
def _():
    stem = "concat_ws('-', lang, CAST(doc_id AS VARCHAR), CAST(poem_no AS VARCHAR))"
    return f"""{WITH_VERSE}, a AS (SELECT doc_id, poem_no, {markup('text', stem)} AS m FROM verse)
    SELECT doc_id, poem_no, CAST(length(m) AS BIGINT) AS markup_chars, md5(m) AS markup_md5 FROM a"""


@sql("newline_codec")
def _():
    enc = f"replace(replace(text, chr(13) || chr(10), {NL}), {NL}, '<NEWLINE>') || '<NEWLINE>'"
    return f"SELECT doc_id, md5({enc}) AS encoded_md5, true AS round_trip FROM documents"


# ---------------------------------------------------------------- 2 rhyme
def tag_window_ctes(src: str) -> str:
    """W1 window form over ``src(doc_id, poem_no, line_no, line)``; ends in CTE ``tg``."""
    s = strip("line")
    return f"""
    t1 AS (SELECT doc_id, poem_no, line_no, line, ({s} <> '' AND NOT starts_with({s}, '<')) AS is_verse FROM {src}),
    t2 AS (SELECT *, CASE WHEN is_verse THEN {D.last_word_for_tagging('line')} ELSE '' END AS word FROM t1),
    t3 AS (SELECT *, (is_verse AND word <> '') AS is_tagged FROM t2),
    t4 AS (SELECT *, CASE WHEN is_tagged THEN {D.rhyme_suffix('word')} END AS suffix FROM t3),
    t5 AS (SELECT *, {D.normalize_word('suffix')} AS rkey,
                  sum(CAST(is_verse AS INTEGER)) OVER (PARTITION BY doc_id, poem_no) AS n_verse,
                  sum(CAST(is_tagged AS INTEGER)) OVER (PARTITION BY doc_id, poem_no ORDER BY line_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS line_index FROM t4),
    t6 AS (SELECT *, CASE WHEN n_verse = 14 THEN (CASE WHEN line_index < 8 THEN 'octave' ELSE 'sestet' END)
                          ELSE 'all' END AS section FROM t5),
    t7 AS (SELECT *, min(line_no) OVER (PARTITION BY doc_id, poem_no, section, is_tagged, rkey) AS first_line FROM t6),
    t8 AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, poem_no, section, is_tagged ORDER BY first_line) - 1
                          AS INTEGER) AS n FROM t7),
    tg AS (SELECT *, CASE WHEN NOT is_tagged THEN NULL
                          WHEN section = 'sestet' THEN chr(67 + n % 5)
                          WHEN n < 7 THEN chr(65 + n) ELSE chr(67 + (n - 7) % 5) END AS letter FROM t8)"""


@sql("rhyme_suffix")
def _():
    s = strip("line")
    return f"""{WITH_LINES},
    a AS (SELECT doc_id, poem_no, line_no, {D.last_word_for_tagging('line')} AS word FROM vlines
          WHERE {s} <> '' AND NOT starts_with({s}, '<')),
    b AS (SELECT *, {D.rhyme_suffix('word')} AS suffix FROM a)
    SELECT doc_id, poem_no, line_no, word, suffix, {D.normalize_word('suffix')} AS rhyme_key FROM b"""


@sql("rhyme_tags")
def _():
    return f"""{WITH_LINES}, {tag_window_ctes('vlines')}
    SELECT doc_id, poem_no, line_no,
           CASE WHEN is_tagged THEN '<RHYME_' || letter || '> ' || suffix || ' | ' || line ELSE line END AS tagged_line
    FROM tg"""


def eval_line_ctes() -> str:
    """``el``: one row per evaluation line with its raw rhyme suffix;
    ``es``: per poem the ordered suffix list (empty list when no lines)."""
    return f"""
    et AS (SELECT doc_id, poem_no, lang, text, {eval_text('text')} AS t FROM verse),
    el0 AS (SELECT doc_id, poem_no, lang, unnest({eval_lines('t')}) AS line,
                   generate_subscripts({eval_lines('t')}, 1) AS line_no FROM et),
    el1 AS (SELECT *, {D.last_word('line')} AS lw FROM el0),
    el AS (SELECT doc_id, poem_no, lang, CAST(line_no AS BIGINT) AS line_no, line, {D.rhyme_suffix('lw')} AS suffix FROM el1),
    es0 AS (SELECT doc_id, poem_no, list(suffix ORDER BY line_no) AS s FROM el GROUP BY doc_id, poem_no),
    es AS (SELECT et.doc_id, et.poem_no, et.lang, et.t, coalesce(es0.s, []) AS s
           FROM et LEFT JOIN es0 ON et.doc_id = es0.doc_id AND et.poem_no = es0.poem_no)"""


@sql("rhyme_scheme")
def _():
    return f"""{WITH_VERSE}, {eval_line_ctes()}
    SELECT doc_id, poem_no, {signature('s')} AS scheme, {signature('list_slice(s, 1, 8)')} AS octave_sig,
           {signature('list_slice(s, 9, len(s))')} AS sestet_sig FROM es"""


def rhymed_line_count(lst: str) -> str:
    return f"len(list_filter({lst}, lambda x: len(list_filter({lst}, lambda y: y = x)) > 1))"


@sql("rhymed_lines")
def _():
    return f"""{WITH_VERSE}, {eval_line_ctes()}
    SELECT doc_id, poem_no, CAST(len(s) AS BIGINT) AS line_count, CAST({rhymed_line_count('s')} AS BIGINT) AS rhyme_lines
    FROM es"""


@sql("rhyme_rate_by_lang")
def _():
    return f"""{WITH_VERSE}, {eval_line_ctes()},
    p AS (SELECT lang, len(s) AS n, {rhymed_line_count('s')} AS r FROM es)
    SELECT lang, CAST(count(*) AS BIGINT) AS poems, CAST(sum(n) AS BIGINT) AS lines,
           CAST(sum(r) AS BIGINT) AS rhymed_lines, round(sum(r) / sum(n), 6) AS rhymed_rate
    FROM p GROUP BY lang"""


# ---------------------------------------------------------------- 3 structure
def check_structure(e: str) -> str:
    c = block_counts(e)
    return (
        f"(len({c}) >= 4 AND coalesce(({c})[1] = 4 AND ({c})[2] = 4, false) "
        f"AND len(list_filter(list_slice({c}, 3, len({c})), lambda x: x <> 3)) = 0)"
    )


@sql("check_structure")
def _():
    return f"""{WITH_VERSE}, a AS (SELECT doc_id, poem_no, {check_structure('text')} AS ok FROM verse)
    SELECT doc_id, poem_no, ok, NOT ok AS unusual FROM a"""


@sql("validate_structure")
def _():
    return f"""{WITH_VERSE}, a AS (SELECT doc_id, poem_no, array_to_string({block_counts('text')}, '-') AS counts FROM verse)
    SELECT doc_id, poem_no, counts, counts IN {_in(S.CLOSED_STRUCTURES)} AS valid FROM a"""


@sql("stanza_lengths")
def _():
    return f"""{WITH_VERSE}
    SELECT doc_id, poem_no, array_to_string({stanza_lengths(eval_text('text'))}, '-') AS lengths FROM verse"""


# ---------------------------------------------------------------- 4 metre
WORD_RE = "'[" + D._L + "]+'"


@sql("syllabify_words")
def _():
    syl = f"array_to_string(list_filter(string_split({D.mark_syllables('word')}, '{D._M}'), lambda s: s <> ''), '|')"
    return f"""WITH w AS (SELECT unnest(regexp_extract_all(text, {WORD_RE})) AS word FROM documents),
    c AS (SELECT word, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY word)
    SELECT word, n, {syl} AS syllables FROM c"""


def syllable_count_ctes(src: str) -> str:
    """Per line of ``src(doc_id, poem_no, lang, line_no, line)`` the counted
    syllables, relationally: blocks as rows, merge flags from ``lag``, merged
    groups by a running sum, tokens per group.  Ends in CTE ``sc``."""
    meta = D.RHYME_LINE
    clean = f"CASE WHEN regexp_matches({strip('line')}, '^[a-z].+\\|\\s+(.*)$') THEN regexp_extract({strip('line')}, '^[a-z].+\\|\\s+(.*)$', 1) ELSE line END"
    return f"""
    h0 AS (SELECT doc_id, poem_no, lang, line_no, line, {clean} AS clean FROM {src}),
    h1 AS (SELECT *, {strip('clean')} AS st FROM h0),
    h2 AS (SELECT *, CASE WHEN st IN ('<SONNET>', '<STANZA>', '<END>') OR st = '' THEN NULL
                          WHEN regexp_matches(st, '{meta}') THEN regexp_extract(st, '{meta}', 3) ELSE clean END AS vtext,
                     CASE WHEN st IN ('<SONNET>', '<STANZA>', '<END>') OR st = '' THEN 0
                          WHEN regexp_matches(st, '{meta}') AND {strip(f"regexp_extract(st, '{meta}', 2)")} <> ''
                               AND regexp_matches(regexp_extract(st, '{meta}', 2), '[{D.ALPHA}]') THEN 1 ELSE 0 END AS extra
              FROM h1),
    hb0 AS (SELECT doc_id, poem_no, line_no, {D.syllable_blocks('vtext')} AS blocks FROM h2 WHERE vtext IS NOT NULL),
    hb AS (SELECT doc_id, poem_no, line_no, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS bi FROM hb0),
    hm AS (SELECT *, lag(b) OVER (PARTITION BY doc_id, poem_no, line_no ORDER BY bi) AS prev FROM hb),
    hf AS (SELECT *, CASE WHEN prev IS NOT NULL AND {D.should_merge('prev', 'b')} THEN 0 ELSE 1 END AS starts FROM hm),
    hg AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, poem_no, line_no ORDER BY bi
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM hf),
    hgs AS (SELECT doc_id, poem_no, line_no, grp, string_agg(b, '' ORDER BY bi) AS g FROM hg GROUP BY doc_id, poem_no, line_no, grp),
    hc AS (SELECT doc_id, poem_no, line_no, sum({D.block_syllables('g')}) AS n FROM hgs GROUP BY doc_id, poem_no, line_no),
    sc AS (SELECT h2.doc_id, h2.poem_no, h2.lang, h2.line_no, CAST(coalesce(hc.n, 0) + h2.extra AS BIGINT) AS syllables
           FROM h2 LEFT JOIN hc ON h2.doc_id = hc.doc_id AND h2.poem_no = hc.poem_no AND h2.line_no = hc.line_no)"""


@sql("syllable_count")
def _():
    return f"""{WITH_VERSE}, {eval_line_ctes()}, {syllable_count_ctes('el')}
    SELECT doc_id, poem_no, line_no, syllables, syllables BETWEEN 10 AND 12 AS valid, syllables = 11 AS valid_strict FROM sc"""


@sql("hendecasyllable_rate")
def _():
    return f"""{WITH_VERSE}, {eval_line_ctes()}, {syllable_count_ctes('el')}
    SELECT lang, CAST(count(*) AS BIGINT) AS lines,
           CAST(sum(CAST(syllables BETWEEN 10 AND 12 AS BIGINT)) AS BIGINT) AS valid_lines,
           CAST(sum(CAST(syllables = 11 AS BIGINT)) AS BIGINT) AS strict_lines,
           round(sum(CAST(syllables BETWEEN 10 AND 12 AS BIGINT)) / count(*), 6) AS valid_rate
    FROM sc GROUP BY lang"""


# ---------------------------------------------------------------- 5 eval
def evaluate_sql(prefix: str | None = None) -> str:
    """A12 twin; ``prefix`` is a WITH clause that defines ``verse`` (default: the verse view)."""
    prefix = WITH_VERSE if prefix is None else prefix

    def sig(x):
        return signature(x)

    lengths = stanza_lengths("t")
    off = "coalesce(list_sum(list_slice(lens, 1, i - 1)), 0)"
    part = f"list_slice(s, {off} + 1, {off} + L)"
    stanza_ok = (
        f"list_sum(list_transform(lens, lambda L, i: CASE WHEN (i <= 2 AND L = 4 AND {sig(part)} IN {_in(S.ALLOWED_QUATRAIN_PATTERNS)}) "
        f"OR (i >= 3 AND L = 3 AND {sig(part)} IN {_in(S.ALLOWED_TERCET_PATTERNS)}) THEN 1 ELSE 0 END))"
    )
    return f"""{prefix}, {eval_line_ctes()}, {syllable_count_ctes('el')},
    hv AS (SELECT doc_id, poem_no, count(*) FILTER (WHERE syllables BETWEEN 10 AND 12) AS vh FROM sc GROUP BY doc_id, poem_no),
    m0 AS (SELECT es.doc_id, es.poem_no, es.lang, es.s, {lengths} AS lens, coalesce(hv.vh, 0) AS vh
           FROM es LEFT JOIN hv ON es.doc_id = hv.doc_id AND es.poem_no = hv.poem_no),
    m1 AS (SELECT *, len(s) AS line_count, coalesce({stanza_ok}, 0) AS valid_stanzas, len(lens) AS total_stanzas FROM m0),
    m AS (SELECT doc_id, poem_no, lang,
                 line_count = 14 AS is_14_lines,
                 array_to_string(lens, '-') = '4-4-3-3' AS is_correct_structure,
                 (line_count = 14 AND total_stanzas = 4 AND valid_stanzas = 4) AS is_valid_stanzas,
                 CAST(valid_stanzas AS BIGINT) AS valid_stanzas,
                 CAST(total_stanzas AS BIGINT) AS total_stanzas,
                 (line_count = 14 AND len(s) = 14 AND vh = 14
                  AND {sig('list_slice(s, 1, 8)')} IN {_in(S.ALLOWED_OCTAVE_PATTERNS)}
                  AND {sig('list_slice(s, 9, len(s))')} IN {_in(S.ALLOWED_SESTET_PATTERNS)}) AS is_valid_sonnet,
                 CAST({rhymed_line_count('s')} AS BIGINT) AS rhyme_lines,
                 CAST(line_count AS BIGINT) AS line_count,
                 CAST(vh AS BIGINT) AS valid_hendecasyllables
          FROM m1)"""


@sql("evaluate_documents")
def _():
    return evaluate_sql() + "\nSELECT * EXCLUDE (lang) FROM m"


def report_sql(src: str) -> str:
    def s(e):
        return f"CAST(sum(CASE WHEN line_count > 0 THEN {e} ELSE 0 END) AS BIGINT)"

    def pct(a, b):
        return f"round(CAST({a} AS DOUBLE) * 100 / nullif({b}, 0), 6)"

    return f"""r AS (SELECT CAST(count(*) AS BIGINT) AS samples,
              {s('CAST(is_14_lines AS BIGINT)')} AS lines_14,
              {s('CAST(is_correct_structure AS BIGINT)')} AS correct_structure,
              {s('valid_stanzas')} AS valid_stanzas, {s('total_stanzas')} AS total_stanzas,
              {s('CAST(is_valid_sonnet AS BIGINT)')} AS valid_sonnets,
              {s('valid_hendecasyllables')} AS valid_hendecasyllables, {s('line_count')} AS total_lines
       FROM {src})
    SELECT *, {pct('lines_14', 'samples')} AS pct_14_lines, {pct('correct_structure', 'samples')} AS pct_correct_structure,
           {pct('valid_stanzas', 'total_stanzas')} AS pct_valid_stanzas,
           {pct('valid_hendecasyllables', 'total_lines')} AS pct_valid_hendecasyllables,
           {pct('valid_sonnets', 'samples')} AS pct_valid_sonnets FROM r"""


@sql("evaluation_report")
def _():
    return evaluate_sql() + ",\n" + report_sql("m")


# ---------------------------------------------------------------- 6 corpus
BUDGET = "(SELECT sum(word_count) // 2 FROM cf)"
CORPUS_CTE = """cp AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS identifier, source AS creator,
                  concat_ws('-', lang, CAST(doc_id AS VARCHAR)) AS title,
                  CAST(1780 + doc_id % 60 AS INTEGER) AS publication_date, text,
                  CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS word_count FROM documents),
    cf AS (SELECT * FROM cp WHERE publication_date IS NOT NULL AND publication_date >= 1791
           AND text IS NOT NULL AND text <> '' AND coalesce(word_count, 0) <> 0)"""
BUDGET_CTE = (
    CORPUS_CTE
    + f""",
    cs AS (SELECT *, coalesce(sum(word_count) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS words_before FROM cf),
    kept AS (SELECT *, least(word_count, {BUDGET} - words_before) AS increment FROM cs WHERE words_before < {BUDGET})"""
)


@sql("corpus_filter")
def _():
    return f"""WITH {CORPUS_CTE}
    SELECT identifier, creator, title, publication_date, word_count, md5(text) AS text_md5 FROM cf"""


@sql("word_budget")
def _():
    return f"""WITH {BUDGET_CTE}
    SELECT doc_id, CAST(word_count AS BIGINT) AS word_count, CAST(words_before AS BIGINT) AS words_before,
           CAST(increment AS BIGINT) AS increment FROM kept"""


@sql("year_counts")
def _():
    return f"""WITH {BUDGET_CTE}
    SELECT publication_date, CAST(count(*) AS BIGINT) AS n FROM kept GROUP BY publication_date"""


@sql("corpus_metadata")
def _():
    return f"""WITH {BUDGET_CTE}
    SELECT 'documents' AS dataset_name, CAST(sum(increment) AS BIGINT) AS total_words,
           CAST(count(DISTINCT publication_date) AS BIGINT) AS n_years, CAST(count(*) AS BIGINT) AS n_docs FROM kept"""


def special_chars(e: str) -> str:
    for k, v in X.SPECIAL_TOKEN_MAP.items():
        e = f"replace({e}, {q(k)}, {q(v)})"
    return e


@sql("corpus_stats")
def _():
    return f"""SELECT CAST(count(*) AS BIGINT) AS documents, round(avg(n), 6) AS mean_chars, CAST(sum(n + 1) AS BIGINT) AS total_chars
    FROM (SELECT length({special_chars('text')}) AS n FROM documents)"""


@sql("word_stats")
def _():
    return """SELECT round(avg(w), 6) AS words_mean, round(CAST(median(w) AS DOUBLE), 6) AS words_median,
           CAST(min(w) AS BIGINT) AS words_min, CAST(max(w) AS BIGINT) AS words_max, round(stddev_pop(w), 6) AS words_std
    FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS w FROM documents)"""


# ---------------------------------------------------------------- 7 vocab
def char_vocab_cte(texts_sql: str, name: str = "cv") -> str:
    return f"""{name} AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id FROM (
        SELECT DISTINCT unnest(string_split({special_chars('text')}, '')) AS token FROM ({texts_sql})
        UNION SELECT chr(10)) WHERE token <> '')"""


DOC_VOCAB = char_vocab_cte("SELECT text FROM documents")


@sql("char_vocab")
def _():
    return f"WITH {DOC_VOCAB} SELECT token, id FROM cv"


@sql("union_vocab")
def _():
    return f"WITH {char_vocab_cte('SELECT text FROM documents UNION ALL SELECT text FROM benchmark')} SELECT token, id FROM cv"


@sql("char_encode")
def _():
    return f"""WITH {DOC_VOCAB},
    b AS (SELECT item_id, CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) THEN text ELSE chr(10) || text END AS t
          FROM benchmark),
    ch AS (SELECT item_id, unnest(list_filter(string_split(t, ''), lambda c: c <> '')) AS token,
                  generate_subscripts(list_filter(string_split(t, ''), lambda c: c <> ''), 1) AS i FROM b),
    e AS (SELECT item_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS s, count(id) AS k FROM ch LEFT JOIN cv USING (token) GROUP BY item_id)
    SELECT b.item_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_tokens, md5(coalesce(e.s, '')) AS ids_md5,
           CAST(coalesce(e.n - e.k, 0) AS BIGINT) AS n_unknown
    FROM b LEFT JOIN e USING (item_id)"""


@sql("decode")
def _():
    specials = [v for k, v in X.SPECIAL_TOKEN_MAP.items() if k != "\n\n<STANZA>\n\n"]
    sk = f"regexp_replace(dec, {q(X.RHYME_MARKING_CHAR)}, '', 'g')"
    for s_ in specials:
        sk = f"replace({sk}, {q(s_)}, '')"
    return f"""WITH {DOC_VOCAB},
    ch AS (SELECT doc_id, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS token,
                  generate_subscripts(list_filter(string_split(text, ''), lambda c: c <> ''), 1) AS i FROM documents),
    dd AS (SELECT doc_id, string_agg(token, '' ORDER BY i) AS dec FROM ch JOIN cv USING (token) GROUP BY doc_id),
    d2 AS (SELECT d.doc_id, d.text, coalesce(dd.dec, '') AS dec FROM documents d LEFT JOIN dd USING (doc_id)),
    d3 AS (SELECT doc_id, dec = text AS round_trip, {sk} AS sk FROM d2)
    SELECT doc_id, round_trip, CAST(length(sk) AS BIGINT) AS decoded_chars, md5(sk) AS decoded_md5 FROM d3"""


@sql("token_id_lookup")
def _():
    return f"""WITH {DOC_VOCAB},
    w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS token FROM benchmark)
    SELECT w.token, CAST(coalesce(cv.id, -1) AS INTEGER) AS id FROM w LEFT JOIN cv USING (token)"""


SPLIT_CTE = """sp0 AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rank,
                    count(*) OVER () AS n FROM documents),
    sp AS (SELECT *, CASE WHEN rank <= CAST(floor(0.9 * n) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM sp0)"""


@sql("split_tokens")
def _():
    return f"""WITH {SPLIT_CTE}
    SELECT split, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_tokens
    FROM sp GROUP BY split"""


@sql("char_streams")
def _():
    return f"""WITH {DOC_VOCAB}, {SPLIT_CTE},
    pf AS (SELECT doc_id, split, rank, rank = min(rank) OVER (PARTITION BY split) AS lead, {special_chars("coalesce(text, '')")} AS text FROM sp),
    pt AS (SELECT doc_id, split, rank, CASE WHEN lead THEN text ELSE chr(10) || text END AS t FROM pf),
    ps AS (SELECT doc_id, split, t, coalesce(sum(length(t)) OVER (PARTITION BY split ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pt),
    pc AS (SELECT doc_id, unnest(list_filter(string_split(t, ''), lambda c: c <> '')) AS token,
                  generate_subscripts(list_filter(string_split(t, ''), lambda c: c <> ''), 1) AS i FROM ps),
    pe AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS s FROM pc JOIN cv USING (token) GROUP BY doc_id)
    SELECT doc_id, split, CAST(start AS BIGINT) AS start, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, md5(coalesce(s, '')) AS ids_md5
    FROM ps LEFT JOIN pe USING (doc_id)"""


# ---------------------------------------------------------------- 8 pack
BATCH, BLOCK = 4, 64


@sql("pack_blocks")
def _():
    bt = BATCH * BLOCK
    return f"""WITH {DOC_VOCAB}, {SPLIT_CTE},
    tr AS (SELECT rank, CASE WHEN rank > 1 THEN chr(10) || text ELSE text END AS t FROM sp WHERE split = 'train'),
    tc AS (SELECT rank, unnest(list_filter(string_split(t, ''), lambda c: c <> '')) AS token,
                  generate_subscripts(list_filter(string_split(t, ''), lambda c: c <> ''), 1) AS i FROM tr),
    ln AS (SELECT rank, count(*) AS len FROM tc GROUP BY rank),
    st AS (SELECT rank, coalesce(sum(len) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ln),
    tk AS (SELECT st.start + tc.i - 1 AS pos, cv.id FROM tc JOIN st USING (rank) LEFT JOIN cv USING (token)),
    nn AS (SELECT CASE WHEN count(*) >= {bt + 1} THEN (count(*) - 1) // {bt} ELSE 0 END * {bt} AS lim FROM tk),
    xs AS (SELECT pos // {BLOCK} AS c, list(id ORDER BY pos) AS x FROM tk WHERE pos < (SELECT lim FROM nn) GROUP BY 1),
    ys AS (SELECT (pos - 1) // {BLOCK} AS c, list(id ORDER BY pos) AS y FROM tk WHERE pos >= 1 AND pos - 1 < (SELECT lim FROM nn) GROUP BY 1)
    SELECT CAST(c // {BATCH} AS BIGINT) AS batch_no, CAST(c % {BATCH} AS BIGINT) AS row_no,
           md5(array_to_string(x, ',')) AS x_md5, md5(array_to_string(y, ',')) AS y_md5,
           CAST(x[1] AS BIGINT) AS x_first, CAST(y[-1] AS BIGINT) AS y_last, CAST(len(x) AS BIGINT) AS block_len
    FROM xs JOIN ys USING (c)"""


DOC_IDS_CTE = """dc AS (SELECT doc_id, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS token,
                   generate_subscripts(list_filter(string_split(text, ''), lambda c: c <> ''), 1) AS i FROM documents),
    di AS (SELECT doc_id, i, id FROM dc JOIN cv USING (token)),
    dp AS (SELECT id, lead(id) OVER (PARTITION BY doc_id ORDER BY i) AS next_id FROM di),
    pairs AS (SELECT id, next_id, count(*) AS n FROM dp WHERE next_id IS NOT NULL GROUP BY id, next_id),
    vs AS (SELECT count(*) AS v FROM cv),
    model AS (SELECT id AS ctx, next_id AS token, n, sum(n) OVER (PARTITION BY id) AS ctx_n FROM pairs)"""


@sql("next_token_pairs")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}
    SELECT CAST(id AS INTEGER) AS id, CAST(next_id AS INTEGER) AS next_id, CAST(n AS BIGINT) AS n FROM pairs"""


# ---------------------------------------------------------------- 10 LM
TEMPERATURE, TOP_K, TOP_P = 0.8, 20, 0.9


@sql("ngram_model")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}
    SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token, CAST(n AS BIGINT) AS n,
           CAST(ctx_n AS BIGINT) AS ctx_n, round((n + 1.0) / (ctx_n + (SELECT v FROM vs)), 6) AS p FROM model"""


@sql("doc_perplexity")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE},
    bc AS (SELECT item_id, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS token,
                  generate_subscripts(list_filter(string_split(text, ''), lambda c: c <> ''), 1) AS i FROM benchmark),
    bi AS (SELECT item_id, i, id FROM bc JOIN cv USING (token)),
    bp AS (SELECT item_id, id AS ctx, lead(id) OVER (PARTITION BY item_id ORDER BY i) AS token FROM bi),
    ctxn AS (SELECT DISTINCT ctx, ctx_n FROM model),
    nl AS (SELECT bp.item_id, -ln((coalesce(m.n, 0) + 1.0) / (coalesce(c.ctx_n, 0) + (SELECT v FROM vs))) AS nll
           FROM bp LEFT JOIN model m ON bp.ctx = m.ctx AND bp.token = m.token LEFT JOIN ctxn c ON bp.ctx = c.ctx
           WHERE bp.token IS NOT NULL)
    SELECT item_id, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 6) AS perplexity
    FROM nl GROUP BY item_id"""


LOGITS = "lg AS (SELECT ctx, token, ln(CAST(n AS DOUBLE)) AS logit FROM model)"


def truncated_ctes(hook: str = "logit") -> str:
    return f"""{LOGITS},
    zh AS (SELECT ctx, token, logit / {TEMPERATURE} AS logit FROM lg),
    z0 AS (SELECT ctx, token, {hook} AS logit FROM zh),
    z1 AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM z0) WHERE r <= {TOP_K}),
    z2 AS (SELECT ctx, token, logit, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM z1),
    z3 AS (SELECT ctx, token, logit, e / sum(e) OVER (PARTITION BY ctx) AS prob FROM z2),
    z4 AS (SELECT *, prob / sum(prob) OVER (PARTITION BY ctx) AS qn FROM z3),
    z5 AS (SELECT *, round(coalesce(sum(qn) OVER (PARTITION BY ctx ORDER BY logit DESC, token ASC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 9) AS before FROM z4),
    z6 AS (SELECT ctx, token, logit, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM z5 WHERE before <= {TOP_P}),
    tp AS (SELECT ctx, token, logit, e / sum(e) OVER (PARTITION BY ctx) AS prob FROM z6)"""


@sql("softmax_t")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}, {LOGITS},
    z AS (SELECT ctx, token, logit / {TEMPERATURE} AS z FROM lg),
    e AS (SELECT ctx, token, exp(z - max(z) OVER (PARTITION BY ctx)) AS e FROM z)
    SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token, round(e / sum(e) OVER (PARTITION BY ctx), 6) AS prob FROM e"""


@sql("top_k")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}, {LOGITS}
    SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token FROM (
      SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM lg) WHERE r <= {TOP_K}"""


@sql("top_p")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}, {truncated_ctes()}
    SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token, round(prob, 6) AS prob FROM tp"""


@sql("top_p_hook")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}, {truncated_ctes('CASE WHEN token % 5 = 0 THEN logit - 2.0 ELSE logit END')}
    SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token, round(prob, 6) AS prob FROM tp"""


@sql("draw")
def _():
    return f"""WITH {DOC_VOCAB}, {DOC_IDS_CTE}, {truncated_ctes()},
    iv AS (SELECT ctx, token, round(hi, 9) AS hi, round(hi - prob, 9) AS lo FROM (
             SELECT *, sum(prob) OVER (PARTITION BY ctx ORDER BY logit DESC, token ASC
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM tp)),
    lastt AS (SELECT ctx, arg_max(token, hi) AS last_token FROM iv GROUP BY ctx),
    bc AS (SELECT item_id, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS token,
                  generate_subscripts(list_filter(string_split(text, ''), lambda c: c <> ''), 1) - 1 AS pos FROM benchmark),
    s AS (SELECT bc.item_id, bc.pos, cv.id AS ctx,
                 CAST(('0x' || substr(md5('42:' || CAST(bc.item_id AS VARCHAR) || ':' || CAST(bc.pos AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u
          FROM bc JOIN cv USING (token)),
    hit AS (SELECT s.item_id, s.pos, min(iv.token) AS token FROM s JOIN iv ON s.ctx = iv.ctx AND s.u >= iv.lo AND s.u < iv.hi GROUP BY s.item_id, s.pos)
    SELECT s.item_id, CAST(s.pos AS INTEGER) AS pos, CAST(s.ctx AS INTEGER) AS ctx, CAST(coalesce(hit.token, lastt.last_token) AS INTEGER) AS token
    FROM s LEFT JOIN hit USING (item_id, pos) LEFT JOIN lastt ON s.ctx = lastt.ctx"""


# ---------------------------------------------------------------- 11 chat / fine-tune
CHAT_CTE = """ch AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
            FROM conversations GROUP BY conv_id)"""


@sql("chat_template")
def _():
    return f"""WITH {CHAT_CTE}
    SELECT conv_id, n_turns, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM ch"""


@sql("chat_lengths")
def _():
    return f"""WITH {CHAT_CTE}, l AS (SELECT len(regexp_extract_all(text, '\\S+')) AS len FROM ch)
    SELECT CAST(max(len) AS BIGINT) AS max_len, CAST(trunc(median(len)) AS BIGINT) AS median_len,
           CAST(trunc(avg(len)) AS BIGINT) AS mean_len, CAST(sum(CAST(len > 512 AS BIGINT)) AS BIGINT) AS over_limit FROM l"""


@sql("finetune_records")
def _():
    pat = "'\\d{1,}\\.\\s(.*)\\.'"
    title = (
        f"CASE WHEN regexp_matches(fname, {pat}) THEN "
        f"regexp_replace(regexp_extract(fname, {pat}, 1), '^[\\]\\[»]+|[\\]\\[»]+$', '', 'g') END"
    )
    return f"""{WITH_VERSE},
    f AS (SELECT doc_id, poem_no, text, CAST(poem_no AS VARCHAR) || '. [' || lang || '-' || CAST(doc_id AS VARCHAR) || '].txt' AS fname FROM verse),
    t AS (SELECT doc_id, poem_no, text, {title} AS title FROM f)
    SELECT doc_id, poem_no, title, md5('<TITLE>' || title || {NL} || {NL} || {strip('text')}) AS record_md5 FROM t"""


# ---------------------------------------------------------------- 12 pages
from versify.functions import html as H  # noqa: E402

WS = "[\\s\\x{a0}]"


#: The character references that the pages hold; &amp; last.
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\xa0"), ("&amp;", "&")]


def unescape(e: str) -> str:
    for k, v in REFERENCES:
        e = f"replace({e}, {q(k)}, {q(v)})"
    return e


def visible_text(e: str, sep: str) -> str:
    t = f"regexp_replace({e}, '(?is)<sup(?:\\s[^>]*)?>.*?</sup>', '', 'g')"
    t = unescape(f"regexp_replace({t}, '<[^>]*>', {q(sep)}, 'g')")
    return strip(f"regexp_replace({t}, '{WS}+', ' ', 'g')")


def normalize_url(e: str) -> str:
    bare = f"regexp_replace(split_part(split_part({e}, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    t = f"CASE WHEN starts_with({bare}, '//') THEN 'https:' WHEN {bare} = '' OR starts_with({bare}, '/') THEN 'https://' ELSE 'https:' END || {bare}"
    return f"regexp_replace({t}, '(?i)/_([\\p{{L}}\\p{{N}}_]+).HTM$', '/__\\1.HTM')"


def shown(html: str) -> str:
    return f"regexp_replace({html}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"


def page_title(html: str, url: str) -> str:
    html = shown(html)
    paras = f"regexp_extract_all({html}, {q(H.PARA_RE)}, 1)"
    a = f"(list_filter(list_transform({paras}, lambda p: {visible_text('p', ' ')}), lambda t: regexp_matches(t, '^\\d+\\.\\s')))[1]"
    # leaf items: what stands between the last <li> and its </li>
    ends = f"list_slice(string_split({html}, '</li>'), 1, -2)"
    items = f"list_transform({ends}, lambda x: regexp_replace(string_split(x, '<li')[-1], '^[^>]*>', ''))"
    text = unescape(f"array_to_string(list_transform(string_split_regex(x, '<[^>]*>'), lambda y: {strip('y')}), '')")
    hit = f"(list_filter(list_transform({items}, lambda x: {text}), lambda t: contains(t, ' . ')))[1]"
    b = f"CASE WHEN {hit} IS NOT NULL THEN substring({hit}, 1, instr({hit}, ' . ') - 1) || '. ' || substring({hit}, instr({hit}, ' . ') + 3) END"
    return f"coalesce({a}, {b}, 'Unknown_Title_' || {normalize_url(url)})"


def paragraph_text(p: str) -> str:
    pieces = f"string_split_regex({p}, '(?i)</sup>')"
    inner = f"regexp_extract(piece, '(?is)<sup(?:\\s[^>]*)?>(.*)$', 1)"
    lifted = (
        f"array_to_string(list_transform({pieces}, lambda piece, i: CASE WHEN i < len({pieces}) THEN "
        f"regexp_replace(piece, '(?is)<sup(?:\\s[^>]*)?>.*$', '') || repeat('<br>', len(regexp_extract_all({inner}, '(?i)<br\\s*/?>'))) "
        f"ELSE piece END), '')"
    )
    t = f"regexp_replace({lifted}, '(?i)<br\\s*/?>', ' ||BR|| ', 'g')"
    t = unescape(f"regexp_replace({t}, '<[^>]*>', '', 'g')")
    t = strip(f"regexp_replace({t}, '{WS}+', ' ', 'g')")
    t = f"regexp_replace({t}, '^\\x{{a0}}+|\\x{{a0}}+$', '', 'g')"
    return f"replace(replace({t}, ' ||BR|| ', {NL}), '||BR||', '')"


def clean_verse(e: str) -> str:
    t = f"replace(replace({e}, chr(13) || chr(10), ' '), chr(10) || chr(13), ' ')"
    t = f"regexp_replace({t}, '\\n\\s{{4}}', ' ', 'g')"
    t = f"regexp_replace({t}, '\\(\\d{{1,2}}\\)', '', 'g')"
    return f"array_to_string(list_transform(string_split({t}, {NL}), lambda l: {strip('l')}), {NL})"


def fix_merged(e: str) -> str:
    pat = "'^(.*?[:;,.?!])\\s+[A-Za-z]'"
    head = f"regexp_extract(l, {pat}, 1)"
    lines = f"list_transform(list_filter(string_split({e}, {NL}), lambda l: {strip('l')} <> ''), lambda l: {strip('l')})"
    fixed = (
        f"flatten(list_transform({lines}, lambda l: CASE WHEN length(l) > 65 AND regexp_matches(l, {pat}) "
        f"THEN [{strip(head)}, {strip(f'substring(l, length({head}) + 1)')}] ELSE [l] END))"
    )
    return format_structure(fixed)


def valid_structure(e: str) -> str:
    return f"(array_to_string({block_counts(e)}, '-') IN {_in(S.CLOSED_STRUCTURES)})"


PAGE_VERSES_CTE = f"""pv0 AS (SELECT page_id, url, html,
                    list_transform(regexp_extract_all({shown('html')}, {q(H.PARA_RE)}, 1), lambda p: {paragraph_text('p')}) AS pt FROM pages),
    pv1 AS (SELECT page_id, url, html, CAST(len(list_filter(pt, lambda t: t <> '')) AS BIGINT) AS n_paragraphs,
                   array_to_string(list_transform(list_filter(pt, lambda t: t <> ''), lambda t: {clean_verse('t')}), {NL} || {NL}) AS full_text
            FROM pv0),
    pv2 AS (SELECT *, {fix_merged('full_text')} AS fixed FROM pv1),
    pv3 AS (SELECT *, {valid_structure('full_text')} AS ok, {valid_structure('fixed')} AS ok_fixed FROM pv2),
    pv AS (SELECT page_id, url, html, n_paragraphs,
                  CASE WHEN ok THEN full_text WHEN ok_fixed THEN fixed ELSE full_text END AS text,
                  (ok OR ok_fixed) AS is_valid, (NOT ok AND ok_fixed) AS repaired FROM pv3)"""


@sql("page_links")
def _():
    # from the rule, not from the Spark pattern: cut at each anchor, take its href value, number those with a slash
    return """WITH a AS (SELECT page_id, unnest((string_split(html, '<a '))[2:]) AS rest,
                     generate_subscripts((string_split(html, '<a '))[2:], 1) AS i FROM pages),
    h AS (SELECT page_id, i, split_part(split_part(split_part(rest, '>', 1), 'href="', 2), '"', 1) AS href FROM a),
    s AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS link_no, href FROM h WHERE contains(href, '/'))
    SELECT page_id, CAST(link_no AS BIGINT) AS link_no, href FROM s WHERE link_no >= 1"""


@sql("url_normalize")
def _():
    return f"SELECT page_id, {normalize_url('url')} AS clean_url FROM pages"


@sql("page_titles")
def _():
    return f"SELECT page_id, {page_title('html', 'url')} AS title FROM pages"


@sql("page_verses")
def _():
    return f"WITH {PAGE_VERSES_CTE} SELECT page_id, n_paragraphs, is_valid, repaired, md5(text) AS text_md5 FROM pv"


@sql("safe_names")
def _():
    name = f"nfc_normalize({strip('title')})"
    name = f"replace(replace(replace({name}, '/', '-'), '\\', '-'), ':', ' - ')"
    name = f"regexp_replace({name}, '[<>:\"|?*\\x00-\\x1F]', '', 'g')"
    fname = f"CASE WHEN {name} = '' THEN 'untitled' ELSE {name} END || '.txt'"
    return f"""WITH {PAGE_VERSES_CTE}, t AS (SELECT page_id, is_valid, {page_title('html', 'url')} AS title FROM pv)
    SELECT page_id, CASE WHEN is_valid THEN {fname} ELSE '[CHECK] ' || {fname} END AS filename FROM t"""


@sql("page_status")
def _():
    return f"""WITH {PAGE_VERSES_CTE}
    SELECT CASE WHEN is_valid THEN 'OK' ELSE 'REVIEW' END AS status, CAST(count(*) AS BIGINT) AS pages FROM pv GROUP BY 1"""


# ---------------------------------------------------------------- 13 run log
EVAL_EVERY, PATIENCE, LOG_EVERY = 5, 15, 10
STEPS_CTE = """st AS (SELECT user_id, event_id, ts, value,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
                   lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events)"""


@sql("best_step")
def _():
    return f"""WITH {STEPS_CTE}, ev AS (SELECT * FROM st WHERE step % {EVAL_EVERY} = 0),
    m AS (SELECT user_id, min(value) AS best_loss, count(*) AS n_evals FROM ev GROUP BY user_id)
    SELECT m.user_id AS run_id, CAST(min(ev.step) AS BIGINT) AS best_step, round(m.best_loss, 6) AS best_loss,
           CAST(m.n_evals AS BIGINT) AS n_evals
    FROM m JOIN ev ON ev.user_id = m.user_id AND ev.value = m.best_loss GROUP BY m.user_id, m.best_loss, m.n_evals"""


@sql("early_stop")
def _():
    return f"""WITH {STEPS_CTE}, ev AS (SELECT * FROM st WHERE step % {EVAL_EVERY} = 0),
    e1 AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev),
    e2 AS (SELECT *, (before IS NULL OR value < before) AS improved FROM e1),
    e3 AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e2),
    e4 AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY step) - 1) * {EVAL_EVERY} AS since FROM e3),
    stops AS (SELECT user_id, min(step) AS stop_step FROM e4 WHERE since >= {PATIENCE} GROUP BY user_id),
    runs AS (SELECT DISTINCT user_id FROM e4),
    ws AS (SELECT runs.user_id, stops.stop_step FROM runs LEFT JOIN stops USING (user_id)),
    ba AS (SELECT e4.user_id, max(e4.step) AS best_step FROM e4 JOIN ws USING (user_id)
           WHERE e4.improved AND (ws.stop_step IS NULL OR e4.step <= ws.stop_step) GROUP BY e4.user_id)
    SELECT ws.user_id AS run_id, CAST(ws.stop_step AS BIGINT) AS stop_step, CAST(ba.best_step AS BIGINT) AS best_step
    FROM ws LEFT JOIN ba USING (user_id)"""


@sql("throughput")
def _():
    dt = "(epoch_us(ts) - epoch_us(prev_ts)) / 1000.0"
    return f"""WITH {STEPS_CTE}
    SELECT user_id AS run_id, CAST(step AS BIGINT) AS step, round({dt}, 3) AS dt_ms,
           round({BATCH * BLOCK} * 1000.0 / nullif({dt}, 0), 6) AS tokens_per_s
    FROM st WHERE step % {LOG_EVERY} = 0"""


# ---------------------------------------------------------------- 9 subword
from versify.operators import bpe as BPE  # noqa: E402

_SPECIAL_ALT = "|".join(BPE.SUBWORD_SPECIALS)


def pretokenize(e: str) -> str:
    """GPT-2 split without look-ahead: a marker before the last blank of every
    blank run that precedes a non-blank reproduces ``\\s+(?!\\S)``."""
    marked = e
    for s_ in BPE.SUBWORD_SPECIALS:
        marked = f"replace({marked}, {q(s_)}, chr(2) || {q(s_)} || chr(2))"
    pieces = f"list_filter(string_split({marked}, chr(2)), lambda p: p <> '')"
    pat = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x01]+|\\s+"
    piece = (
        f"CASE WHEN p IN {_in(BPE.SUBWORD_SPECIALS)} THEN [p] ELSE regexp_extract_all("
        f"regexp_replace(CASE WHEN starts_with(p, ' ') THEN p ELSE ' ' || p END, '(\\s*)(\\s)(\\S)', '\\1' || chr(1) || '\\2\\3', 'g'), "
        f"{q(pat)}) END"
    )
    return f"flatten(list_transform({pieces}, lambda p: {piece}))"


def to_symbols(e: str) -> str:
    return f"regexp_replace(lower(hex(encode({e}))), '([0-9a-f]{{2}})', '<\\1>', 'g')"


WORDS_CTE = f"""pw AS (SELECT unnest({pretokenize('text')}) AS word FROM documents),
    w0 AS MATERIALIZED (SELECT word, CAST(count(*) AS BIGINT) AS freq, {to_symbols('word')} AS sym
                        FROM pw WHERE word NOT IN {_in(BPE.SUBWORD_SPECIALS)} GROUP BY word)"""


def pairs_sql(w: str) -> str:
    return f"""(SELECT l AS "left", r AS "right", CAST(sum(freq) AS BIGINT) AS count FROM (
        SELECT freq, unnest(s) AS l, unnest(s[2:]) AS r FROM (SELECT freq, regexp_extract_all(sym, '<[0-9a-f]+>') AS s FROM {w}))
        WHERE r IS NOT NULL GROUP BY l, r)"""


@sql("pretokenize")
def _():
    return f"WITH {WORDS_CTE} SELECT word, freq FROM w0"


@sql("bpe_pairs")
def _():
    return f"WITH {WORDS_CTE} SELECT * FROM {pairs_sql('w0')}"


N_MERGES = 1730


def pair_list(sym: str) -> str:
    symbols = f"regexp_extract_all({sym}, '<[0-9a-f]+>')"
    return f"list_zip({symbols}, {symbols}[2:])"


#: One merge in each step of a keyed recursion, whose table holds the words (w), the counts of all pairs (p), the merges (m) and
#: their number (n): a step renews the words that hold the best pair, and the pairs that go or come in them.
BPE_CTES = f"""{WORDS_CTE},
    p0 AS MATERIALIZED {pairs_sql('w0')},
    st(kind, key, sym, freq, l, r) USING KEY (kind, key) AS (
      SELECT 'w' AS kind, word AS key, sym, freq, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS r FROM w0
      UNION ALL SELECT 'p', "left" || "right", NULL, count, "left", "right" FROM p0
      UNION ALL SELECT 'n', '', NULL, 0, NULL, NULL
      UNION
      (WITH b AS MATERIALIZED (
         SELECT l, r, freq, l || r AS lr, '<' || substr(l, 2, length(l) - 2) || substr(r, 2, length(r) - 2) || '>' AS made,
                (SELECT freq FROM recurring.st WHERE kind = 'n') AS k
         FROM recurring.st WHERE kind = 'p' AND freq >= 2 AND (SELECT freq FROM recurring.st WHERE kind = 'n') < {N_MERGES}
         ORDER BY freq DESC, l, r LIMIT 1),
       t AS MATERIALIZED (SELECT w.key, w.freq, w.sym AS before, replace(w.sym, b.lr, b.made) AS after
                          FROM recurring.st w, b WHERE w.kind = 'w' AND contains(w.sym, b.lr)),
       d0 AS (SELECT unnest({pair_list('before')}) AS z, -freq AS f FROM t UNION ALL SELECT unnest({pair_list('after')}), freq FROM t),
       d AS (SELECT z[1] AS l, z[2] AS r, CAST(sum(f) AS BIGINT) AS f FROM d0 WHERE z[2] IS NOT NULL GROUP BY ALL HAVING sum(f) <> 0)
       SELECT 'w', key, after, freq, NULL, NULL FROM t
       UNION ALL SELECT 'p', d.l || d.r, NULL, d.f + coalesce(o.freq, 0), d.l, d.r
                 FROM d LEFT JOIN (SELECT * FROM recurring.st WHERE kind = 'p') o ON o.key = d.l || d.r
       UNION ALL SELECT 'm', CAST(k AS VARCHAR), made, freq, l, r FROM b
       UNION ALL SELECT 'n', '', NULL, k + 1, NULL, NULL FROM b)),
    mg AS MATERIALIZED (SELECT CAST(key AS BIGINT) AS rank, l AS "left", r AS "right", freq AS count, sym AS made FROM st WHERE kind = 'm'),
    wf AS MATERIALIZED (SELECT key AS word, regexp_extract_all(sym, '<[0-9a-f]+>') AS s FROM st WHERE kind = 'w')"""


@sql("bpe_train")
def _():
    return f"""WITH RECURSIVE {BPE_CTES} SELECT rank, "left", "right", count FROM mg"""


#: bpe_encode, bpe_ids and token_stats have no twin: each would train again in SQL, for minutes; the tests hold their encoding
#: against the merges in rank order.
@sql("bpe_decode")
def _():
    """What is asked of decoding: the pre-tokenized words themselves, whatever the merges."""
    return f"SELECT doc_id, true AS round_trip, CAST({len(BPE.SUBWORD_SPECIALS) + 256 + N_MERGES} AS BIGINT) AS vocab_size FROM documents"


# ---------------------------------------------------------------- 1 text: special tokens
SPECIAL_CTES = f"""{D.VERSE_CTE},
    mk AS (SELECT doc_id, poem_no, {markup('text', None)} AS m FROM verse),
    ml AS (SELECT doc_id, poem_no, CAST(ln AS BIGINT) AS line_no, line FROM (
             SELECT doc_id, poem_no, unnest(string_split(m, {NL})) AS line, generate_subscripts(string_split(m, {NL}), 1) AS ln FROM mk)),
    {tag_window_ctes('ml')},
    tt AS (SELECT doc_id, poem_no, string_agg(CASE WHEN is_tagged THEN '<RHYME_' || letter || '> ' || suffix || ' | ' || line ELSE line END,
                                              {NL} ORDER BY line_no) AS tagged FROM tg GROUP BY doc_id, poem_no),
    sc0 AS (SELECT doc_id, poem_no, tagged, {special_chars('tagged')} AS chars FROM tt)"""


@sql("special_tokens")
def _():
    stripped = f"replace(replace(regexp_replace(chars, {q(X.RHYME_MARKING_CHAR)}, '', 'g'), '¶', ''), '§', '')"
    compact = "regexp_replace(tagged, '(?m)^(<RHYME_[A-Z]>) (\\S+) \\| ', '\\1\\2|', 'g')"
    syl = f"regexp_replace({compact}, {q(X.RHYME_MARKING_SYLLABLE)}, '', 'g')"
    return f"""WITH {SPECIAL_CTES}
    SELECT doc_id, poem_no, md5(chars) AS chars_md5, CAST(length(chars) AS BIGINT) AS chars_len,
           md5({stripped}) AS stripped_md5, md5({syl}) AS syllable_md5 FROM sc0"""


# ---------------------------------------------------------------- 14 streaming (batch twins)
@sql("stream_ingest")
def _():
    return ORACLE["corpus_filter"]


@sql("stream_budget")
def _():
    return ORACLE["word_budget"]


@sql("stream_encode")
def _():
    return f"""WITH {SPECIAL_CTES},
    ch AS (SELECT doc_id, poem_no, unnest(string_split(chars, '')) AS c, generate_subscripts(string_split(chars, ''), 1) AS i FROM sc0),
    vo AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT c FROM ch WHERE c <> '' UNION SELECT chr(10))),
    ids AS (SELECT doc_id, poem_no, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM ch JOIN vo USING (c) GROUP BY ALL)
    SELECT doc_id, poem_no, CAST(length(chars) AS BIGINT) AS chars_len, md5(chars) AS chars_md5, CAST(coalesce(n, 0) AS BIGINT) AS n_ids,
           md5(coalesce(ids, '')) AS ids_md5, CAST(0 AS BIGINT) AS n_unknown FROM sc0 LEFT JOIN ids USING (doc_id, poem_no)"""


@sql("hash_split")
def _():
    return "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) < floor(0.9 * 4294967296) THEN 'train' ELSE 'val' END AS split FROM documents"


@sql("split_overlap")
def _():
    return """WITH r AS (SELECT md5('42:' || doc_id) AS h, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rank, count(*) OVER () AS n FROM documents)
    SELECT CASE WHEN rank <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS exact,
           CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) < floor(0.9 * 4294967296) THEN 'train' ELSE 'val' END AS bucket, count(*) AS docs FROM r GROUP BY ALL"""


@sql("pretrain_quarantine")
def _():
    return f"""WITH {CORPUS_CTE},
    q AS (SELECT identifier, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'publication_date' WHEN doc_id % 17 = 0 THEN 'word_count' END AS reason FROM cp)
    SELECT identifier, CASE WHEN reason IS NULL THEN 'good' ELSE 'rejected' END AS sink, reason, count(*) OVER (PARTITION BY reason IS NULL) AS in_sink FROM q"""


@sql("page_quarantine")
def _():
    return f"""WITH {PAGE_VERSES_CTE},
    q AS (SELECT page_id, CASE WHEN html IS NULL THEN 'no page' WHEN n_paragraphs = 0 THEN 'no paragraphs' WHEN NOT is_valid THEN 'structure' END AS reason FROM pv)
    SELECT page_id, CASE WHEN reason IS NULL THEN 'good' ELSE 'rejected' END AS sink, reason FROM q"""


@sql("container_links")
def _():
    # the stand-in's container is the menu: anchors from its start tag to its end tag
    return f"""WITH b AS (SELECT page_id, {shown('html')} AS html FROM pages),
    ar AS (SELECT page_id, split_part(split_part(html, '<nav>', 2), '</nav>', 1) AS part FROM b),
    a AS (SELECT page_id, unnest((string_split(part, '<a '))[2:]) AS rest, generate_subscripts((string_split(part, '<a '))[2:], 1) AS i FROM ar)
    SELECT page_id, CAST(i - 1 AS BIGINT) AS link_no, split_part(split_part(split_part(rest, '>', 1), 'href="', 2), '"', 1) AS href FROM a"""


@sql("stream_eval")
def _():
    return evaluate_sql() + ",\n" + report_sql("m")


@sql("stream_years")
def _():
    return f"WITH {CORPUS_CTE} SELECT publication_date, CAST(count(*) AS BIGINT) AS n FROM cf GROUP BY publication_date"


# ---------------------------------------------------------------- 15 metadata sinks
@sql("dataset_metadata")
def _():
    return f"""WITH {DOC_VOCAB}, {SPLIT_CTE},
    t AS (SELECT split, sum(length(text)) + count(*) - 1 AS n FROM sp GROUP BY split)
    SELECT 'documents' AS dataset, CAST((SELECT count(*) FROM cv) AS BIGINT) AS vocab_size,
           CAST((SELECT n FROM t WHERE split = 'train') AS BIGINT) AS train_tokens,
           CAST((SELECT n FROM t WHERE split = 'val') AS BIGINT) AS val_tokens"""


@sql("run_summary")
def _():
    return f"""WITH {STEPS_CTE}, ev AS (SELECT * FROM st WHERE step % {EVAL_EVERY} = 0),
    m AS (SELECT user_id, min(value) AS best, max(step) AS last FROM ev GROUP BY user_id)
    SELECT m.user_id AS run_id, round(m.best, 6) AS best_val_loss, CAST(min(ev.step) AS BIGINT) AS best_step,
           CAST(m.last AS BIGINT) AS steps_done
    FROM m JOIN ev ON ev.user_id = m.user_id AND ev.value = m.best GROUP BY m.user_id, m.best, m.last"""


# ---------------------------------------------------------------- 4 metre: syllable tokens
def syllable_token_ctes(src: str) -> str:
    """Tokens of ``src(doc_id, poem_no, text)`` as rows (doc_id, poem_no, li, t, tok),
    relationally: blocks -> merge flags (lag) -> groups -> parts -> blank moving
    (each token = previous token's trailing blanks + blank parts it owns + its head)."""
    meta = D.RHYME_LINE
    L = D._L
    return f"""
    yl AS (SELECT doc_id, poem_no, CAST(li AS BIGINT) AS li, line, {strip('line')} AS st FROM (
             SELECT doc_id, poem_no, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS li FROM {src})),
    yk AS (SELECT *, CASE WHEN st IN ('<SONNET>', '<STANZA>', '<END>') THEN 'special' WHEN st = '' THEN 'blank'
                          WHEN regexp_matches(st, '{meta}') THEN 'meta' ELSE 'verse' END AS kind FROM yl),
    yv AS (SELECT doc_id, poem_no, li, CASE WHEN kind = 'meta' THEN regexp_extract(st, '{meta}', 3) ELSE line END AS v
           FROM yk WHERE kind IN ('meta', 'verse')),
    yb0 AS (SELECT doc_id, poem_no, li, {D.syllable_blocks('v')} AS blocks FROM yv),
    yb AS (SELECT doc_id, poem_no, li, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS bi FROM yb0),
    ym AS (SELECT *, lag(b) OVER (PARTITION BY doc_id, poem_no, li ORDER BY bi) AS prev FROM yb),
    yg0 AS (SELECT *, CASE WHEN prev IS NOT NULL AND {D.should_merge('prev', 'b')} THEN 0 ELSE 1 END AS starts FROM ym),
    yg1 AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, poem_no, li ORDER BY bi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM yg0),
    yg AS (SELECT doc_id, poem_no, li, g, string_agg(b, '' ORDER BY bi) AS gs FROM yg1 GROUP BY doc_id, poem_no, li, g),
    yp0 AS (SELECT doc_id, poem_no, li, g, CASE WHEN {D.kept_whole('gs')} THEN [gs]
                   ELSE regexp_extract_all(gs, '\\s+|[^{L}\\s]|[{L}]+') END AS parts FROM yg),
    yp AS (SELECT doc_id, poem_no, li, g, unnest(parts) AS p, generate_subscripts(parts, 1) AS pi FROM yp0),
    yq AS (SELECT *, regexp_matches(p, '^\\s+$') AS ws FROM yp),
    yr AS (SELECT *, sum(CASE WHEN ws THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, poem_no, li ORDER BY g, pi
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM yq),
    ytok AS (SELECT doc_id, poem_no, li, k AS t, regexp_extract(p, '^(.*?)[ \\t]*$', 1) AS head,
                    regexp_extract(p, '([ \\t]*)$', 1) AS tail FROM yr WHERE NOT ws),
    yws AS (SELECT doc_id, poem_no, li, k + 1 AS t, string_agg(p, '' ORDER BY g, pi) AS blanks FROM yr WHERE ws GROUP BY doc_id, poem_no, li, k),
    ylast AS (SELECT doc_id, poem_no, li, coalesce(max(t), 0) AS kmax FROM ytok GROUP BY doc_id, poem_no, li),
    yt AS (
      SELECT x.doc_id, x.poem_no, x.li, x.t,
             coalesce(lag(x.tail) OVER (PARTITION BY x.doc_id, x.poem_no, x.li ORDER BY x.t), '') || coalesce(w.blanks, '') || x.head AS tok
      FROM ytok x LEFT JOIN yws w ON x.doc_id = w.doc_id AND x.poem_no = w.poem_no AND x.li = w.li AND x.t = w.t),
    yend AS (
      SELECT l.doc_id, l.poem_no, l.li, l.kmax + 1 AS t,
             coalesce((SELECT tail FROM ytok z WHERE z.doc_id = l.doc_id AND z.poem_no = l.poem_no AND z.li = l.li AND z.t = l.kmax), '')
             || coalesce(w.blanks, '') AS tok
      FROM (SELECT DISTINCT doc_id, poem_no, li FROM yr) r0
      JOIN ylast l ON r0.doc_id = l.doc_id AND r0.poem_no = l.poem_no AND r0.li = l.li
      LEFT JOIN yws w ON w.doc_id = l.doc_id AND w.poem_no = l.poem_no AND w.li = l.li AND w.t = l.kmax + 1),
    yline AS (
      SELECT doc_id, poem_no, li, t + 10 AS t, tok FROM yt
      UNION ALL SELECT doc_id, poem_no, li, t + 10, tok FROM yend WHERE tok <> ''
      UNION ALL SELECT doc_id, poem_no, li, 1, regexp_extract(st, '{meta}', 1) FROM yk WHERE kind = 'meta'
      UNION ALL SELECT doc_id, poem_no, li, 2, {strip(f"regexp_extract(st, '{meta}', 2)")} FROM yk WHERE kind = 'meta'
      UNION ALL SELECT doc_id, poem_no, li, 3, '|' FROM yk WHERE kind = 'meta'
      UNION ALL SELECT doc_id, poem_no, li, 1, st FROM yk WHERE kind = 'special'
      UNION ALL SELECT doc_id, poem_no, li, 1000000000, {NL} FROM yk),
    ylist AS (SELECT doc_id, poem_no, list(tok ORDER BY li, t) AS toks FROM yline GROUP BY doc_id, poem_no),
    ytoks AS (SELECT doc_id, poem_no, CASE WHEN len(toks) > 0 AND toks[-1] = {NL} THEN toks[1:len(toks) - 1] ELSE toks END AS toks FROM ylist)"""


@sql("syllable_tokens")
def _():
    return f"""{WITH_VERSE}, {syllable_token_ctes('verse')}
    SELECT doc_id, poem_no, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, chr(31))) AS tokens_md5 FROM ytoks"""


SYL_VOCAB_CTES = f"""{D.VERSE_CTE},
    mkv AS (SELECT doc_id, poem_no, {markup('text', None)} AS text FROM verse),
    {syllable_token_ctes('mkv')},
    sd AS (SELECT DISTINCT unnest(toks) AS token FROM ytoks),
    sv AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - CASE WHEN (SELECT count(*) FROM sd WHERE token = '<UNK>') > 0 THEN 1 ELSE 0 END AS INTEGER) AS id FROM sd
           UNION ALL SELECT '<UNK>', 0 WHERE (SELECT count(*) FROM sd WHERE token = '<UNK>') = 0)"""


@sql("syllable_vocab")
def _():
    return f"WITH {SYL_VOCAB_CTES} SELECT token, id FROM sv"


@sql("syllable_encode")
def _():
    bsrc = (
        "(SELECT item_id AS doc_id, 0 AS poem_no, CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) "
        f"THEN text ELSE {NL} || text END AS text FROM benchmark)"
    )
    yb = syllable_token_ctes(bsrc)
    # second token pipeline: rename its CTEs so both can live in one WITH
    import re as _re

    names = _re.findall(r"\b(y[a-z0-9]*) AS \(", yb)
    for n in sorted(set(names), key=len, reverse=True):
        yb = _re.sub(rf"\b{n}\b", "b_" + n, yb)
    return f"""WITH {SYL_VOCAB_CTES}, {yb},
    bt AS (SELECT doc_id AS item_id, unnest(toks) AS token FROM b_ytoks),
    tot AS (SELECT item_id, count(*) AS n_all FROM bt GROUP BY item_id),
    kn AS (SELECT item_id, count(*) AS n, sum(id) AS s FROM bt JOIN sv USING (token) GROUP BY item_id)
    SELECT tot.item_id, CAST(coalesce(kn.n, 0) AS BIGINT) AS n_tokens, CAST(coalesce(kn.s, 0) AS BIGINT) AS id_sum,
           CAST(tot.n_all - coalesce(kn.n, 0) AS BIGINT) AS n_dropped
    FROM tot LEFT JOIN kn USING (item_id)"""


@sql("syllable_streams")
def _():
    import re as _re

    yb = syllable_token_ctes("zord")
    for n in sorted(set(_re.findall(r"\b(y[a-z0-9]*) AS \(", yb)), key=len, reverse=True):
        yb = _re.sub(rf"\b{n}\b", "b_" + n, yb)
    return f"""WITH {SYL_VOCAB_CTES},
    zr AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id || '-' || poem_no)) AS rank, count(*) OVER () AS total FROM mkv),
    zp AS (SELECT *, CASE WHEN rank <= CAST(floor(0.9 * total) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM zr),
    zord AS (SELECT doc_id, poem_no, rank, split, CASE WHEN rank = min(rank) OVER (PARTITION BY split) THEN text ELSE chr(10) || text END AS text FROM zp),
    {yb},
    zt AS (SELECT doc_id, poem_no, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM b_ytoks),
    ze AS (SELECT doc_id, poem_no, count(*) AS n, string_agg(id, ',' ORDER BY i) AS s FROM zt JOIN sv USING (token) GROUP BY doc_id, poem_no)
    SELECT doc_id, poem_no, split,
           CAST(coalesce(sum(n) OVER (PARTITION BY split ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
           CAST(n AS BIGINT) AS n_tokens, md5(s) AS ids_md5
    FROM zord JOIN ze USING (doc_id, poem_no)"""


@sql("syllable_tokens_tagged")
def _():
    return f"""WITH {SPECIAL_CTES}, tx AS (SELECT doc_id, poem_no, tagged AS text FROM tt), {syllable_token_ctes('tx')}
    SELECT doc_id, poem_no, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, chr(31))) AS tokens_md5 FROM ytoks"""


@sql("syllable_id_lookup")
def _():
    import re as _re

    yb = syllable_token_ctes("(SELECT item_id AS doc_id, 0 AS poem_no, text FROM benchmark)")
    for n in sorted(set(_re.findall(r"\b(y[a-z0-9]*) AS \(", yb)), key=len, reverse=True):
        yb = _re.sub(rf"\b{n}\b", "b_" + n, yb)
    return f"""WITH {SYL_VOCAB_CTES}, {yb}, bt AS (SELECT DISTINCT unnest(toks) AS token FROM b_ytoks)
    SELECT token, CAST(coalesce(sv.id, (SELECT id FROM sv WHERE token = '<UNK>'), -1) AS INTEGER) AS id FROM bt LEFT JOIN sv USING (token)"""


@sql("finetune_titles")
def _():
    return "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang || '-' || doc_id END AS title FROM documents"


# ---------------------------------------------------------------- 10 LM: generation
MAX_NEW_TOKENS = 512


CTX_ORDER, DISCOUNT = 3, 0.75


def chars_sql(e: str) -> str:
    return f"list_filter(string_split({e}, ''), lambda c: c <> '')"


def history_sql(source: str, key: str) -> str:
    """(key, history, token) of the known characters of each text, by windows."""
    before = " || ".join(f"coalesce(lag(token, {k}) OVER (PARTITION BY {key} ORDER BY i), '')" for k in range(CTX_ORDER, 0, -1))
    return f"""(SELECT {key}, token, {before} AS history FROM (SELECT {key}, token, i FROM (
               SELECT {key}, unnest({chars_sql('text')}) AS token, generate_subscripts({chars_sql('text')}, 1) AS i FROM {source}) JOIN cv USING (token)))"""


def context_ctes() -> str:
    levels = ["""pl0 AS (SELECT ctx, token, n, backoff, direct + backoff / (SELECT count(*) FROM cv) AS p FROM cxst WHERE length(ctx) = 0)"""]
    for k in range(1, CTX_ORDER + 1):
        levels.append(f"""pl{k} AS (SELECT s.ctx, s.token, s.n, s.backoff, s.direct + s.backoff * l.p AS p
             FROM cxst s JOIN pl{k - 1} l ON l.ctx = substr(s.ctx, 2) AND l.token = s.token WHERE length(s.ctx) = {k})""")
    union = " UNION ALL ".join(f"SELECT * FROM pl{k}" for k in range(CTX_ORDER + 1))
    return f"""cxg AS (SELECT history, token, count(*) AS n FROM {history_sql('documents', 'doc_id')} GROUP BY ALL),
    cxe AS (SELECT unnest(list_transform(range(0, length(history) + 1), lambda k: substr(history, length(history) - k + 1))) AS ctx, token, n FROM cxg),
    cxc AS (SELECT ctx, token, sum(n) AS n FROM cxe GROUP BY ALL),
    cxs AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS ctx_n, count(*) OVER (PARTITION BY ctx) AS kinds FROM cxc),
    cxst AS MATERIALIZED (SELECT ctx, token, n, CAST({DISCOUNT} AS DOUBLE) * kinds / ctx_n AS backoff, (n - CAST({DISCOUNT} AS DOUBLE)) / ctx_n AS direct FROM cxs),
    {', '.join(levels)},
    cxm AS MATERIALIZED ({union})"""


@sql("context_model")
def _():
    return f"WITH {DOC_VOCAB}, {context_ctes()} SELECT ctx, token, CAST(n AS BIGINT) AS n, round(p, 6) AS p, round(backoff, 6) AS backoff FROM cxm"


@sql("context_perplexity")
def _():
    """By recursion of its definition for every character, contexts shortened one by one."""
    p = "1.0 / (SELECT count(*) FROM cv)"
    joins = []
    for k in range(CTX_ORDER + 1):
        cut = f"substr(g.history, length(g.history) - {k} + 1)"
        joins.append(f"LEFT JOIN cxm m{k} ON length(g.history) >= {k} AND m{k}.ctx = {cut} AND m{k}.token = g.token LEFT JOIN cxb b{k} ON length(g.history) >= {k} AND b{k}.ctx = {cut}")
        p = f"coalesce(m{k}.p, coalesce(b{k}.backoff, 1.0) * ({p}))"
    return f"""WITH {DOC_VOCAB}, {context_ctes()}, cxb AS (SELECT DISTINCT ctx, backoff FROM cxm),
    cxp AS (SELECT g.item_id, -ln({p}) AS nll FROM {history_sql('benchmark', 'item_id')} g {' '.join(joins)})
    SELECT item_id, CAST(count(*) AS BIGINT) AS n_chars, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 6) AS perplexity FROM cxp GROUP BY item_id"""


def generated_sql() -> str:
    """A WITH clause that ends in ``verse``, the generated samples."""
    u = "CAST(('0x' || substr(md5('42:' || CAST(g.sample_id AS VARCHAR) || ':' || CAST(g.step AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    truncated = truncated_ctes().replace(LOGITS, "lg AS (SELECT ctx, token, ln(p) AS logit FROM cxm)")
    return f"""WITH RECURSIVE {DOC_VOCAB}, {context_ctes()}, {truncated},
    cxi AS MATERIALIZED (SELECT ctx, token, round(hi, 9) AS hi, round(hi - prob, 9) AS lo FROM (
             SELECT *, sum(prob) OVER (PARTITION BY ctx ORDER BY logit DESC, token ASC
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM tp)),
    cxt AS MATERIALIZED (SELECT ctx, list(struct_pack(hi := hi, lo := lo, token := token) ORDER BY hi) AS cands FROM cxi GROUP BY ctx),
    cxk AS (SELECT item_id, string_agg(token, '' ORDER BY i) AS known FROM (
             SELECT item_id, unnest({chars_sql('text')}) AS token, generate_subscripts({chars_sql('text')}, 1) AS i FROM benchmark) JOIN cv USING (token) GROUP BY item_id),
    cxr AS (SELECT item_id AS sample_id, coalesce(substr(known, greatest(length(known) - {CTX_ORDER - 1}, 1)), '') AS tail FROM benchmark LEFT JOIN cxk USING (item_id)),
    cxn AS (
      SELECT sample_id, 0 AS step, tail, '' AS text, false AS done, 0 AS n_new FROM cxr
      UNION ALL
      SELECT sample_id, step + 1, CASE WHEN tok IS NULL THEN tail ELSE substr(ctx || tok, greatest(length(ctx || tok) - {CTX_ORDER - 1}, 1)) END,
             text || coalesce(tok, ''), tok IS NULL OR tok = chr(10), n_new + CASE WHEN tok IS NULL THEN 0 ELSE 1 END
      FROM (SELECT g.sample_id, g.step, g.tail, g.text, g.n_new, c.ctx,
                   coalesce(list_filter(c.cands, lambda x: {u} >= x.lo AND {u} < x.hi)[1].token, c.cands[-1].token) AS tok
            FROM (SELECT sample_id, step, tail, text, n_new, coalesce(c3.ctx, c2.ctx, c1.ctx, '') AS use
                  FROM cxn LEFT JOIN cxt c3 ON c3.ctx = tail LEFT JOIN cxt c2 ON c2.ctx = right(tail, 2) LEFT JOIN cxt c1 ON c1.ctx = right(tail, 1)
                  WHERE NOT done AND step < {MAX_NEW_TOKENS}) g LEFT JOIN cxt c ON c.ctx = g.use)),
    cxf AS (SELECT sample_id, arg_max(text, step) AS text, arg_max(done, step) AS done, arg_max(n_new, step) AS n_new FROM cxn GROUP BY sample_id),
    verse AS (SELECT CAST(sample_id AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS poem_no, 'gen' AS lang, text, n_new, done FROM cxf)"""


@sql("generate_batch")
def _():
    return evaluate_sql(generated_sql()) + """
    SELECT m.doc_id AS item_id, CAST(v.n_new AS BIGINT) AS n_new, v.done AS stopped, m.line_count,
           m.valid_hendecasyllables, m.rhyme_lines
    FROM m JOIN verse v ON m.doc_id = v.doc_id"""


@sql("generation_report")
def _():
    return evaluate_sql(generated_sql()) + ",\n" + report_sql("m")


# ---------------------------------------------------------------- 9 subword: Unigram seeds
@sql("unigram_seed")
def _():
    from versify.operators import unigram as UG

    alt = "|".join(s.replace("[", "\\[").replace("]", "\\]") for s in UG.USER_SYMBOLS)
    safe = f"replace(replace(text, chr(13) || chr(10), {NL}), {NL}, ' <NEWLINE> ')"
    return f"""WITH uw0 AS (SELECT unnest(regexp_extract_all({safe}, {q(alt + '|' + chr(92) + 'S+')})) AS tok FROM documents),
    uw AS (SELECT '{UG.WORD_MARK}' || tok AS word, count(*) AS freq FROM uw0 WHERE tok NOT IN {_in(UG.USER_SYMBOLS)} GROUP BY tok),
    us0 AS (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM uw),
    us1 AS (SELECT word, freq, i, unnest(range(1, least({UG.MAX_LEN}, length(word) - i + 1) + 1)) AS k FROM us0),
    cnt AS (SELECT substring(word, i, k) AS piece, sum(freq) AS count FROM us1 GROUP BY 1),
    multi AS (SELECT * FROM cnt WHERE length(piece) > 1 AND count >= 2 ORDER BY count * length(piece) DESC, piece LIMIT {UG.SEEDS})
    SELECT piece, CAST(count AS BIGINT) AS count FROM cnt WHERE length(piece) = 1
    UNION ALL SELECT piece, CAST(count AS BIGINT) FROM multi"""


@sql("word_counts")
def _():
    return """SELECT word, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT unnest(regexp_extract_all(text, '\\S+')) AS word FROM documents) GROUP BY word"""
