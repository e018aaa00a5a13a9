"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (whole tables, whole texts) and returns a
DataFrame whose column names match its DuckDB twin in ``oracle.py``.
Counts are ``bigint``, ratios ``double`` rounded to 6 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versify.functions import html as H
from versify.functions import rhyme as R
from versify.functions import structure as S
from versify.functions import syllable as Y
from versify.functions import text as X
from versify.operators import bpe as BPE
from versify.operators import context_lm as CL
from versify.operators import corpus as C
from versify.operators import lm as LM
from versify.operators import pack as P
from versify.operators import runlog as RL
from versify.operators import unigram as UG
from versify.operators import vocab as V
from versify.operators.evaluate import evaluate_frame, evaluation_report
from versify.operators.rhyme_tags import is_verse, tag_rhymes_frame
from versify.operators.verse import verse_lines, verse_view
from versify.plans import files
from versify.session import ensure_checkpoint_dir
from versify.sources import io as IO
from versify.sources.tables import read_table
from versify.streaming import ingest as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(files.QUERIES)


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *(cols or ("doc_id", "lang", "text")))


def verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verse_view(documents(spark, sf_dir, "doc_id", "lang", "text"))


def poem_stem(df: DataFrame) -> F.Column:
    return F.concat_ws("-", F.col("lang"), F.col("doc_id").cast("string"), F.col("poem_no").cast("string"))


def ratio(num, den) -> F.Column:
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 6)


# ---------------------------------------------------------------- 1 text
@query
def q_clean_text(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    c = X.clean_text(F.col("text"))
    return d.select(
        "doc_id", F.length(c).cast("long").alias("clean_chars"), F.md5(c).alias("clean_md5")
    )


@query
def q_clean_verse(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    c = X.clean_verse(F.col("text"))
    return d.select("doc_id", F.length(c).cast("long").alias("verse_chars"), F.md5(c).alias("verse_md5"))


@query
def q_layout(spark, sf_dir):
    v = verse(spark, sf_dir)
    lines = S.eval_lines(F.col("text"))
    laid = X.format_structure(lines)
    return v.select(
        "doc_id",
        "poem_no",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.split(laid, "\n\n", -1)).cast("long").alias("n_blocks"),
        F.md5(laid).alias("layout_md5"),
    )


@query
def q_fix_merged_lines(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    fixed = X.fix_merged_lines(F.col("text"))
    return d.select(
        "doc_id",
        F.size(F.split(fixed, "\n", -1)).cast("long").alias("n_rows"),
        F.md5(fixed).alias("fixed_md5"),
    )


@query
def q_markup(spark, sf_dir):
    v = verse(spark, sf_dir)
    m = X.markup(F.col("text"), poem_stem(v))
    return v.select(
        "doc_id", "poem_no", F.length(m).cast("long").alias("markup_chars"), F.md5(m).alias("markup_md5")
    )


@query
def q_special_tokens(spark, sf_dir):
    """Tag rhymes with suffixes, map specials to chars (C12), strip the char
    rhyme prefix (C13) and the specials but SEP (C15); the syllable-stream
    prefix (C14) runs on the de-spaced tag form."""
    v = verse(spark, sf_dir).select("doc_id", "poem_no", X.markup(F.col("text")).alias("m"))
    t = tag_rhymes_frame(v, "m", "tagged", with_suffix=True).withColumn("chars", X.to_special_chars(F.col("tagged")))
    stripped = X.remove_specials(X.strip_char_rhyme_prefix(F.col("chars")), ["¶", "§"])
    compact = F.regexp_replace(F.col("tagged"), r"(?m)^(<RHYME_[A-Z]>) (\S+) \| ", "$1$2|")
    syl = X.strip_syllable_rhyme_prefix(compact)
    return t.select(
        "doc_id",
        "poem_no",
        F.md5("chars").alias("chars_md5"),
        F.length("chars").cast("long").alias("chars_len"),
        F.md5(stripped).alias("stripped_md5"),
        F.md5(syl).alias("syllable_md5"),
    )


@query
def q_newline_codec(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    enc = X.encode_newlines(F.col("text"))
    back = X.decode_newlines(enc)
    return d.select(
        "doc_id",
        F.md5(enc).alias("encoded_md5"),
        (back == F.concat(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\n"))).alias("round_trip"),
    )


# ---------------------------------------------------------------- 2 rhyme
def _tag_lines(spark, sf_dir):
    lines = verse_lines(verse(spark, sf_dir))
    return lines.where(is_verse(F.col("line")))


@query
def q_rhyme_suffix(spark, sf_dir):
    lines = _tag_lines(spark, sf_dir).withColumn("word", R.last_word_for_tagging(F.col("line")))
    sfx = lines.withColumn("suffix", R.rhyme_suffix(F.col("word")))
    return sfx.select(
        "doc_id", "poem_no", F.col("line_no").cast("long").alias("line_no"), "word", "suffix",
        R.normalize_word(F.col("suffix")).alias("rhyme_key"),
    )


@query
def q_rhyme_tags(spark, sf_dir):
    v = verse(spark, sf_dir)
    tagged = tag_rhymes_frame(v.select("doc_id", "poem_no", "text"), "text", "t", with_suffix=True)
    return tagged.select(
        "doc_id", "poem_no", F.posexplode(F.split("t", "\n", -1)).alias("pos", "tagged_line")
    ).select("doc_id", "poem_no", (F.col("pos") + 1).cast("long").alias("line_no"), "tagged_line")


@query
def q_rhyme_scheme(spark, sf_dir):
    v = verse(spark, sf_dir)
    suffixes = S.line_suffixes(S.eval_lines(S.eval_text(F.col("text"))))
    return v.select("doc_id", "poem_no", suffixes.alias("s")).select(
        "doc_id",
        "poem_no",
        R.pattern_signature(F.col("s")).alias("scheme"),
        R.pattern_signature(F.slice("s", 1, 8)).alias("octave_sig"),
        R.pattern_signature(F.slice("s", 9, 1 << 30)).alias("sestet_sig"),
    )


@query
def q_rhymed_lines(spark, sf_dir):
    v = verse(spark, sf_dir)
    suffixes = S.line_suffixes(S.eval_lines(S.eval_text(F.col("text"))))
    return v.select("doc_id", "poem_no", suffixes.alias("s")).select(
        "doc_id",
        "poem_no",
        F.size("s").cast("long").alias("line_count"),
        S.rhymed_line_count(F.col("s")).cast("long").alias("rhyme_lines"),
    )


def rhyme_rate_by_lang(v: DataFrame) -> DataFrame:
    suffixes = S.line_suffixes(S.eval_lines(S.eval_text(F.col("text"))))
    per_poem = v.select("lang", suffixes.alias("s")).select(
        "lang", F.size("s").alias("n"), S.rhymed_line_count(F.col("s")).alias("r")
    )
    return per_poem.groupBy("lang").agg(
        F.count(F.lit(1)).cast("long").alias("poems"),
        F.sum("n").cast("long").alias("lines"),
        F.sum("r").cast("long").alias("rhymed_lines"),
        ratio(F.sum("r"), F.sum("n")).alias("rhymed_rate"),
    )


@query
def q_rhyme_rate_by_lang(spark, sf_dir):
    return rhyme_rate_by_lang(verse(spark, sf_dir))


# ---------------------------------------------------------------- 3 structure
@query
def q_check_structure(spark, sf_dir):
    v = verse(spark, sf_dir)
    return v.select(
        "doc_id", "poem_no", S.check_structure(F.col("text")).alias("ok"),
        (~S.check_structure(F.col("text"))).alias("unusual"),
    )


@query
def q_validate_structure(spark, sf_dir):
    v = verse(spark, sf_dir)
    return v.select(
        "doc_id",
        "poem_no",
        F.array_join(S.block_counts(F.col("text")), "-").alias("counts"),
        S.validate_structure(F.col("text")).alias("valid"),
    )


@query
def q_stanza_lengths(spark, sf_dir):
    v = verse(spark, sf_dir)
    return v.select(
        "doc_id", "poem_no", F.array_join(S.stanza_lengths(S.eval_text(F.col("text"))), "-").alias("lengths")
    )


# ---------------------------------------------------------------- 4 metre
WORD_RE = f"[{Y.LETTERS}]+"


@query
def q_syllabify_words(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit(WORD_RE), 0)).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return counted.select("word", "n", F.array_join(Y.syllabify_word(F.col("word")), "|").alias("syllables"))


def _eval_line_rows(spark, sf_dir):
    """Evaluation lines as rows, each with its dotted form (the poem text is
    dotted once; the syllable rules never cross a newline)."""
    v = verse(spark, sf_dir).withColumn("_t", S.eval_text(F.col("text")))
    pairs = F.arrays_zip(S.eval_lines(F.col("_t")).alias("line"), S.eval_lines(Y.dot_syllables(F.col("_t"))).alias("mline"))
    return v.select("doc_id", "poem_no", "lang", F.posexplode(pairs).alias("pos", "p")).select(
        "doc_id", "poem_no", "lang", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("p.line").alias("line"),
        F.col("p.mline").alias("mline"),
    )


def _line_count(rows: DataFrame) -> F.Column:
    meta = F.col("line").contains("|") & F.col("line").rlike(Y.EVAL_RHYME_PREFIX)
    return F.when(meta, Y.hendecasyllable_count(F.col("line"))).otherwise(Y.dots(F.col("mline")))


@query
def q_syllable_count(spark, sf_dir):
    rows = _eval_line_rows(spark, sf_dir)
    return rows.withColumn("n", _line_count(rows)).select(
        "doc_id", "poem_no", "line_no", F.col("n").cast("long").alias("syllables"),
        F.col("n").between(10, 12).alias("valid"), (F.col("n") == 11).alias("valid_strict"),
    )


@query
def q_hendecasyllable_rate(spark, sf_dir):
    rows = _eval_line_rows(spark, sf_dir)
    rows = rows.withColumn("n", _line_count(rows))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).cast("long").alias("lines"),
        F.sum(F.col("n").between(10, 12).cast("long")).cast("long").alias("valid_lines"),
        F.sum((F.col("n") == 11).cast("long")).cast("long").alias("strict_lines"),
        ratio(F.sum(F.col("n").between(10, 12).cast("long")), F.count(F.lit(1))).alias("valid_rate"),
    )


@query
def q_syllable_tokens(spark, sf_dir):
    v = verse(spark, sf_dir)
    toks = Y.syllabify_text(F.col("text"))
    return v.select(
        "doc_id", "poem_no", F.size(toks).cast("long").alias("n_tokens"),
        F.md5(F.array_join(toks, "\u001f")).alias("tokens_md5"),
    )


# ---------------------------------------------------------------- 5 eval
@query
def q_evaluate_documents(spark, sf_dir):
    return evaluate_frame(verse(spark, sf_dir), ["doc_id", "poem_no"])


@query
def q_evaluation_report(spark, sf_dir):
    return evaluation_report(evaluate_frame(verse(spark, sf_dir), ["doc_id", "poem_no"]))


# ---------------------------------------------------------------- 6 corpus

BATCH, BLOCK = 4, 64
TEMPERATURE, TOP_K, TOP_P = 0.8, 20, 0.9


def corpus(spark, sf_dir):
    return C.pretrain_view(documents(spark, sf_dir, "doc_id", "lang", "source", "text"))


def half_of_words(spark, sf_dir) -> int:
    """A budget that is crossed in the middle of the corpus, whatever its size."""
    ensure_checkpoint_dir(spark)
    return C.content_filter(C.year_filter(corpus(spark, sf_dir))).agg(F.coalesce(F.sum("word_count"), F.lit(0))).first()[0] // 2


@query
def q_corpus_filter(spark, sf_dir):
    kept = C.project_corpus(C.content_filter(C.year_filter(corpus(spark, sf_dir))))
    return kept.select(
        "identifier", "creator", "title", "publication_date", "word_count", F.md5("text").alias("text_md5")
    )


@query
def q_word_budget(spark, sf_dir):
    kept = C.word_budget(corpus(spark, sf_dir), half_of_words(spark, sf_dir))
    return kept.select(
        "doc_id", F.col("word_count").cast("long").alias("word_count"),
        F.col("words_before").cast("long").alias("words_before"), F.col("increment").cast("long").alias("increment"),
    )


@query
def q_year_counts(spark, sf_dir):
    return C.year_counts(C.word_budget(corpus(spark, sf_dir), half_of_words(spark, sf_dir)))


@query
def q_corpus_metadata(spark, sf_dir):
    meta = C.corpus_metadata(C.word_budget(corpus(spark, sf_dir), half_of_words(spark, sf_dir)), "documents")
    return meta.select(
        "dataset_name", "total_words", F.size("publication_years").cast("long").alias("n_years"),
        F.aggregate(F.map_values("publication_years"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_docs"),
    )


@query
def q_corpus_stats(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").select(F.length(X.to_special_chars(F.col("text"))).alias("n"))
    return d.agg(
        F.count(F.lit(1)).cast("long").alias("documents"),
        F.round(F.avg("n"), 6).alias("mean_chars"),
        F.sum(F.col("n") + 1).cast("long").alias("total_chars"),
    )


@query
def q_word_stats(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").select(C.word_count(F.col("text")).alias("w"))
    return C.length_stats(d, F.col("w"), "words")


# ---------------------------------------------------------------- 7 vocab
def doc_char_vocab(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return V.char_vocab(documents(spark, sf_dir, "doc_id", "text"))


@query
def q_char_vocab(spark, sf_dir):
    return doc_char_vocab(spark, sf_dir)


@query
def q_union_vocab(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    texts = documents(spark, sf_dir, "text").unionByName(read_table(spark, sf_dir, "benchmark", "text"))
    return V.char_vocab(texts)


@query
def q_char_encode(spark, sf_dir):
    """J1 + T3 strict encode of the held-out benchmark with the corpus vocabulary."""
    codec = V.char_codec(doc_char_vocab(spark, sf_dir))
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    first = b.agg(F.min("item_id")).first()[0]  # one scalar
    t = b.select(
        "item_id", F.when(F.col("item_id") == F.lit(first), F.col("text")).otherwise(F.concat(F.lit("\n"), "text")).alias("t")
    )
    e = t.select("item_id", F.length("t").alias("n"), F.length(codec.unknown(F.col("t"))).alias("u"), codec.encode(codec.known(F.col("t"))).alias("ids"))
    return e.select(
        "item_id",
        F.col("n").cast("long").alias("n_tokens"),
        F.md5(F.array_join("ids", ",")).alias("ids_md5"),
        F.col("u").cast("long").alias("n_unknown"),
    )


@query
def q_decode(spark, sf_dir):
    """J3 + J7 + C15 + U3: encode, nest in chunks, flatten, decode, drop specials but SEP."""
    codec = V.char_codec(doc_char_vocab(spark, sf_dir))
    d = documents(spark, sf_dir, "doc_id", "text")
    e = codec.encode_rows(d)
    chunks = F.floor(F.greatest(F.size("ids") - 1, F.lit(0)) / 64).cast("int")
    nested = e.select("doc_id", "text", F.transform(F.sequence(F.lit(0), chunks), lambda i: F.slice("ids", i * 64 + 1, 64)).alias("nested"))
    dec = codec.decode_rows(nested.select("doc_id", "text", F.flatten("nested").alias("ids")))
    specials = [v for k, v in X.SPECIAL_TOKEN_MAP.items() if k != "\n\n<STANZA>\n\n"]
    sk = dec.select("doc_id", (F.col("dec") == F.col("text")).alias("round_trip"), X.remove_specials(X.strip_char_rhyme_prefix(F.col("dec")), specials).alias("sk"))
    return sk.select("doc_id", "round_trip", F.length("sk").cast("long").alias("decoded_chars"), F.md5("sk").alias("decoded_md5"))


@query
def q_token_id_lookup(spark, sf_dir):
    vocab = doc_char_vocab(spark, sf_dir)
    words = read_table(spark, sf_dir, "benchmark", "text").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("token")
    ).distinct()
    return V.token_id(words, vocab).select("token", F.col("id").cast("int").alias("id"))


def doc_split(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return V.train_val_split(documents(spark, sf_dir, "doc_id", "text"), "doc_id")


@query
def q_split_tokens(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    s = V.train_val_split(documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.length("text").alias("ln")), "doc_id")
    return s.groupBy("split").agg(
        F.count(F.lit(1)).cast("long").alias("n_docs"),
        (F.sum("ln") + F.count(F.lit(1)) - 1).cast("long").alias("n_tokens"),
    )


@query
def q_char_streams(spark, sf_dir):
    """The corpus as two streams of ids in shuffle order with separators, written and read back."""
    ensure_checkpoint_dir(spark)
    codec = V.char_codec(doc_char_vocab(spark, sf_dir))
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", X.to_special_chars(F.coalesce("text", F.lit(""))).alias("text"))
    places = P.stream_places(d.select("doc_id", F.length("text").cast("long").alias("ln")), "doc_id")
    path = files.folder(spark, "streams")
    IO.write_streams(P.encoded_streams(d, places, "doc_id", codec), path)
    back = IO.read_streams(spark, path)
    return back.select("doc_id", F.col("split").cast("string").alias("split"), "start", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


# ---------------------------------------------------------------- 8 pack
def keyed_texts(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select(V.shuffle_key(F.col("doc_id")).alias("_shuf"), "text")


def with_separator(text: F.Column) -> F.Column:
    """A train text of the stream: the separator before every document but the first."""
    return F.when(F.col("rank") > 1, F.concat(F.lit("\n"), text)).otherwise(text)


def train_places(spark, sf_dir):
    """(_shuf, rank, start) of the train split, where each document begins in the stream in shuffle order, and the tokens
    of the stream, from text lengths (one character = one token).  Only keys and lengths move; both are written once."""
    ensure_checkpoint_dir(spark)
    lengths = keyed_texts(spark, sf_dir).select("_shuf", F.length("text").cast("long").alias("n")).checkpoint()
    ranks = V.shuffle_ranks(lengths.select("_shuf")).where(F.col("split") == "train").select("_shuf", "rank")
    ln = F.col("n") + F.when(F.col("rank") > 1, 1).otherwise(0)
    starts = C.running_total(lengths.join(ranks, "_shuf").select("rank", ln.alias("ln")), "rank", "ln", "start")
    places = ranks.join(starts.select("rank", "start"), "rank").select("_shuf", "rank", "start").checkpoint()
    return places, lengths.join(places, "_shuf").agg(F.sum(ln)).first()[0] or 0  # one scalar


def train_texts(spark, sf_dir, places):
    """(start, t): train documents, separators in front, at their global positions; the texts join their places once."""
    return keyed_texts(spark, sf_dir).join(places, "_shuf").select("start", with_separator(F.col("text")).alias("t"))


def train_edges(spark, sf_dir, places, codec, w):
    """(start, ln, head, tail): lengths and encoded first and last ``w`` characters of the train documents, cut before
    they join their places."""
    n = F.length("text")
    cut = keyed_texts(spark, sf_dir).select(
        "_shuf",
        n.cast("long").alias("n"),
        F.substring("text", 1, w).alias("first"),
        F.substring(F.col("text"), F.greatest(n - (w - 1), F.lit(1)), F.lit(w)).alias("last"),
    )
    ln = F.col("n") + F.when(F.col("rank") > 1, 1).otherwise(0)
    t = with_separator(F.col("first"))  # all of a text no longer than w
    edges = cut.join(places, "_shuf").select(
        "start", ln.alias("ln"), F.substring(t, 1, w).alias("h"), F.when(ln <= w, t).otherwise(F.col("last")).alias("t")
    )
    return edges.select("start", "ln", codec.encode(F.col("h")).alias("head"), codec.encode(F.col("t")).alias("tail"))


@query
def q_pack_blocks(spark, sf_dir):
    """The stream length comes from text lengths; interior cells slice the
    fully encoded documents where they are encoded, boundary cells only need each
    document's first and last block + 1 characters encoded."""
    codec = V.char_codec(doc_char_vocab(spark, sf_dir))
    places, n = train_places(spark, sf_dir)
    edges = train_edges(spark, sf_dir, places, codec, BLOCK + 1)
    return P.pack_from_docs(train_texts(spark, sf_dir, places), n, BATCH, BLOCK, "t", edges, codec, digest=True)


def counted_pairs(spark, sf_dir):
    """(id, next_id, n) of the corpus, and the vocabulary it is counted with."""
    vocab = doc_char_vocab(spark, sf_dir)
    return P.next_token_pairs(P.char_pairs(documents(spark, sf_dir, "text")), vocab), vocab


@query
def q_next_token_pairs(spark, sf_dir):
    pairs, _ = counted_pairs(spark, sf_dir)
    return pairs.select(
        F.col("id").cast("int").alias("id"), F.col("next_id").cast("int").alias("next_id"), "n"
    )


# ---------------------------------------------------------------- 10 LM
def bigram(spark, sf_dir):
    pairs, vocab = counted_pairs(spark, sf_dir)
    return LM.bigram_model(pairs, vocab.count()), vocab


@query
def q_ngram_model(spark, sf_dir):
    m, _ = bigram(spark, sf_dir)
    return m.select(
        F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"), "n",
        F.col("ctx_n").cast("long").alias("ctx_n"), F.round("p", 6).alias("p"),
    )


@query
def q_doc_perplexity(spark, sf_dir):
    """L2 + L3 + A14 on the held-out benchmark (unknown characters dropped, J2)."""
    m, vocab = bigram(spark, sf_dir)
    codec = V.char_codec(vocab)
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", codec.known(F.col("text")).alias("text"))
    pairs = P.next_token_pairs(P.char_pairs(b, ("item_id",)), vocab, ("item_id",))
    nll = LM.pair_nll(pairs.select("item_id", F.col("id").alias("ctx"), F.col("next_id").alias("token"), F.col("n").alias("times")), m, len(codec))
    per = nll.groupBy("item_id").agg(F.sum("times").cast("long").alias("n_pairs"), (F.sum(F.col("nll") * F.col("times")) / F.sum("times")).alias("loss"))
    return per.select("item_id", "n_pairs", F.round("loss", 6).alias("loss"), F.round(F.exp("loss"), 6).alias("perplexity"))


def logits(spark, sf_dir):
    m, _ = bigram(spark, sf_dir)
    return m.select("ctx", "token", F.log(F.col("n").cast("double")).alias("logit"))


@query
def q_softmax_t(spark, sf_dir):
    d = LM.softmax_t(logits(spark, sf_dir), TEMPERATURE)
    return d.select(F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"), F.round("prob", 6).alias("prob"))


@query
def q_top_k(spark, sf_dir):
    d = LM.top_k(logits(spark, sf_dir), TOP_K)
    return d.select(F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"))


@query
def q_top_p(spark, sf_dir):
    d = LM.truncated(logits(spark, sf_dir), TEMPERATURE, TOP_K, TOP_P)
    return d.select(F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"), F.round("prob", 6).alias("prob"))


@query
def q_top_p_hook(spark, sf_dir):
    """V1: a hook between temperature and truncation; here every fifth token is held back."""

    def held_back(d: DataFrame) -> DataFrame:
        return d.withColumn("logit", F.when(F.col("token") % 5 == 0, F.col("logit") - 2.0).otherwise(F.col("logit")))

    d = LM.truncated(logits(spark, sf_dir), TEMPERATURE, TOP_K, TOP_P, held_back)
    return d.select(F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"), F.round("prob", 6).alias("prob"))


@query
def q_draw(spark, sf_dir):
    """K4: a draw after each character of each benchmark text, from the truncated distribution of that character."""
    iv = LM.intervals(LM.truncated(logits(spark, sf_dir), TEMPERATURE, TOP_K, TOP_P))
    chars = V.explode_chars(read_table(spark, sf_dir, "benchmark", "item_id", "text"), ["item_id"])
    samples = chars.join(doc_char_vocab(spark, sf_dir), "token").select(
        F.struct("item_id", "pos").alias("sample_id"), F.col("id").alias("ctx"), LM.uniform(F.col("item_id"), F.col("pos")).alias("u")
    )
    return LM.draw(samples, iv).select("sample_id.item_id", "sample_id.pos", F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"))


# ---------------------------------------------------------------- 11 chat / fine-tune


def render_turn(role: F.Column, text: F.Column) -> F.Column:
    """ChatML block of one message."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def chat_texts(spark, sf_dir):
    """C20 + V3: one ChatML string per conversation, messages in turn order."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    msgs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", render_turn(F.col("role"), F.col("text")).alias("r")))).alias("m"))
    return msgs.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.array_join(F.transform("m", lambda x: x["r"]), "").alias("text"))


@query
def q_chat_template(spark, sf_dir):
    t = chat_texts(spark, sf_dir)
    return t.select("conv_id", "n_turns", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query
def q_chat_lengths(spark, sf_dir):
    """A4 + V4: length column (whitespace tokens of the template), then max, int
    median, int mean and the over-limit count.  A rendered message ends with a
    newline, so a conversation's length is the sum over its messages: one
    ``groupBy`` sum, no conversation is ever collected into a row."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "role", "text")
    per_msg = c.select("conv_id", C.word_count(render_turn(F.col("role"), F.col("text"))).alias("n"))
    t = per_msg.groupBy("conv_id").agg(F.sum("n").alias("len"))
    return t.agg(
        F.max("len").cast("long").alias("max_len"),
        F.median("len").cast("long").alias("median_len"),
        F.avg("len").cast("long").alias("mean_len"),
        F.sum((F.col("len") > 512).cast("long")).cast("long").alias("over_limit"),
    )


@query
def q_finetune_records(spark, sf_dir):
    """C18 + C19 (+ S7 layout): file name ``N. [lang-doc].txt`` -> title -> record."""
    v = verse(spark, sf_dir)
    fname = F.concat(F.col("poem_no").cast("string"), F.lit(". ["), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("].txt"))
    t = v.select("doc_id", "poem_no", "text", X.finetune_title(fname).alias("title"))
    rec = X.finetune_record(F.col("title"), F.col("text"))
    return t.select("doc_id", "poem_no", "title", F.md5(rec).alias("record_md5"))


def scratch(spark, name):
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def q_hash_split(spark, sf_dir):
    """K6 by buckets."""
    return V.hash_split(documents(spark, sf_dir, "doc_id"), "doc_id").select("doc_id", "split")


@query
def q_split_overlap(spark, sf_dir):
    """K6: how far the exact split and the one by buckets agree, and their shares."""
    d = documents(spark, sf_dir, "doc_id")
    exact = V.train_val_split(d, "doc_id").select("doc_id", F.col("split").alias("exact"))
    both = exact.join(V.hash_split(d, "doc_id"), "doc_id").groupBy("exact", F.col("split").alias("bucket"))
    return both.agg(F.count(F.lit(1)).cast("long").alias("docs"))


@query
def q_pretrain_quarantine(spark, sf_dir):
    """S3: rows whose year or word count can't be read go to a sink of their own, with the reason; here some are spoilt."""
    c = corpus(spark, sf_dir)
    year = F.when(F.col("doc_id") % 11 == 0, "n.d.").when(F.col("doc_id") % 13 == 0, F.concat(F.lit("c. "), F.col("publication_date").cast("string"))).otherwise(F.col("publication_date").cast("string"))
    words = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("word_count").cast("string"))
    raw = c.select("identifier", year.alias("publication_date"), words.alias("word_count"))
    reason = F.when(F.col("publication_date").try_cast("int").isNull(), "publication_date").when(F.col("word_count").try_cast("int").isNull(), "word_count")
    good, rejected, counts = IO.write_quarantined(raw, reason, scratch(spark, "quarantine"))
    rows = good.select("identifier", F.lit("good").alias("sink"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("identifier", F.lit("rejected").alias("sink"), "reason"))
    return rows.withColumn("in_sink", F.when(F.col("sink") == "good", counts["good"]).otherwise(counts["rejected"]).cast("long"))


@query
def q_page_quarantine(spark, sf_dir):
    """Pages without verse, or whose verse has no known structure even after repair, kept apart with the reason."""
    v = page_verses(pages(spark, sf_dir))
    reason = F.when(F.col("html").isNull(), "no page").when(F.col("n_paragraphs") == 0, "no paragraphs").when(~F.col("is_valid"), "structure")
    good, rejected, _ = IO.write_quarantined(v.select("page_id", "html", "n_paragraphs", "is_valid"), reason, scratch(spark, "quarantine"))
    return good.select("page_id", F.lit("good").alias("sink"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("page_id", F.lit("rejected").alias("sink"), "reason"))


@query
def q_container_links(spark, sf_dir):
    """H1: links of the container with an id, in page order; the pages' menus stand in for it."""
    html = F.replace(F.replace(F.col("html"), F.lit("<nav>"), F.lit('<div id="post-body"><div class="text">')), F.lit("</nav>"), F.lit("</div></div>"))
    p = pages(spark, sf_dir).select("page_id", H.links(H.container(html, "post-body")).alias("hrefs"))
    return p.select("page_id", F.posexplode("hrefs").alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("link_no"), "href")


# ---------------------------------------------------------------- 12 pages
def pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", "page_id", "url", "html")


def page_links(p: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """H1 + H2 + K8: anchors with a slash in page order; of those, ``skip`` left out, then at most ``limit`` kept (None: all)."""
    fitting = F.filter(H.links(F.col("html")), lambda h: h.contains("/"))
    chosen = F.slice(fitting, skip + 1, F.lit(limit) if limit is not None else F.greatest(F.size(fitting), F.lit(1)))
    return p.select("page_id", F.posexplode(chosen).alias("pos", "href")).select("page_id", (F.col("pos") + skip).cast("long").alias("link_no"), "href")


@query
def q_page_links(spark, sf_dir):
    return page_links(pages(spark, sf_dir), skip=1)


@query
def q_url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.normalize_url(F.col("url")).alias("clean_url"))


@query
def q_page_titles(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("page_id", H.page_title(F.col("html"), H.normalize_url(F.col("url"))).alias("title"))


def page_verses(p: DataFrame, style_re: str | None = None) -> DataFrame:
    """H6 + H7 + H8: verse paragraphs -> cleaned text -> validate, else repair, flag."""
    paras = p.select("page_id", "url", "html", H.paragraph_texts(H.paragraphs(F.col("html"), style_re)).alias("_pt"))
    verses = paras.select(
        "page_id", "url", "html",
        F.array_join(F.transform(F.filter("_pt", lambda t: t != ""), X.clean_verse), "\n\n").alias("_full"),
        F.size(F.filter("_pt", lambda t: t != "")).cast("long").alias("n_paragraphs"),
    )
    fixed = verses.withColumn("_fixed", X.fix_merged_lines(F.col("_full")))
    ok = S.validate_structure(F.col("_full"))
    ok_fixed = S.validate_structure(F.col("_fixed"))
    return fixed.select(
        "page_id", "url", "html", "n_paragraphs",
        F.when(ok, F.col("_full")).when(ok_fixed, F.col("_fixed")).otherwise(F.col("_full")).alias("text"),
        (ok | ok_fixed).alias("is_valid"),
        (~ok & ok_fixed).alias("repaired"),
    )


@query
def q_page_verses(spark, sf_dir):
    v = page_verses(pages(spark, sf_dir))
    return v.select("page_id", "n_paragraphs", "is_valid", "repaired", F.md5("text").alias("text_md5"))


@query
def q_safe_names(spark, sf_dir):
    v = page_verses(pages(spark, sf_dir))
    title = H.page_title(F.col("html"), H.normalize_url(F.col("url")))
    return v.select("page_id", H.safe_filename(title, F.col("is_valid")).alias("filename"))


@query
def q_page_status(spark, sf_dir):
    v = page_verses(pages(spark, sf_dir))
    st = F.when(F.col("is_valid"), F.lit("OK")).otherwise(F.lit("REVIEW"))
    return v.groupBy(st.alias("status")).agg(F.count(F.lit(1)).cast("long").alias("pages"))


# ---------------------------------------------------------------- 13 run log
EVAL_EVERY, PATIENCE, LOG_EVERY = 5, 15, 10


def run_steps(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    ensure_checkpoint_dir(spark)
    return RL.ordered_steps(e)


@query
def q_best_step(spark, sf_dir):
    b = RL.best_step(RL.eval_rows(run_steps(spark, sf_dir), EVAL_EVERY))
    return b.select(F.col("user_id").alias("run_id"), "best_step", F.round("best_loss", 6).alias("best_loss"), "n_evals")


@query
def q_early_stop(spark, sf_dir):
    s = RL.early_stop(RL.eval_rows(run_steps(spark, sf_dir), EVAL_EVERY), EVAL_EVERY, PATIENCE)
    return s.select(F.col("user_id").alias("run_id"), F.col("stop_step").cast("long").alias("stop_step"), F.col("best_step").cast("long").alias("best_step"))


@query
def q_throughput(spark, sf_dir):
    t = RL.throughput(run_steps(spark, sf_dir), LOG_EVERY, BATCH * BLOCK)
    return t.select(F.col("user_id").alias("run_id"), "step", "dt_ms", "tokens_per_s")


# ---------------------------------------------------------------- 9 subword

#: The surveyed vocabulary of 2,000: 14 specials, 256 bytes and the merges.
N_MERGES = 1730


@query
def q_pretokenize(spark, sf_dir):
    """T1 + T2: pre-tokenized word frequencies of the corpus."""
    return BPE.word_table(documents(spark, sf_dir, "text")).select("word", "freq")


@query
def q_word_counts(spark, sf_dir):
    """Distributed word counts (whitespace words of every document): one
    aggregate with map-side combining, so a very frequent word costs one row
    per partition before the shuffle."""
    d = documents(spark, sf_dir, "text")
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query
def q_bpe_pairs(spark, sf_dir):
    return BPE.pair_counts(BPE.word_table(documents(spark, sf_dir, "text")))


#: Tokenizers trained in this session, by application, corpus and kind: one training serves all queries that encode.
_TRAINED: dict = {}


def trained_once(spark, sf_dir, kind, train):
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in _TRAINED:
        ensure_checkpoint_dir(spark)
        _TRAINED[key] = train()
    return _TRAINED[key]


def trained_bpe(spark, sf_dir):
    return trained_once(spark, sf_dir, "bpe", lambda: BPE.train_bpe(documents(spark, sf_dir, "text"), N_MERGES))


@query
def q_bpe_train(spark, sf_dir):
    _, merges = trained_bpe(spark, sf_dir)
    return spark.createDataFrame(merges, "rank int, left string, right string, count long").select(
        F.col("rank").cast("long").alias("rank"), "left", "right", "count"
    )


@query
def q_bpe_encode(spark, sf_dir):
    _, merges = trained_bpe(spark, sf_dir)
    return BPE.doc_token_counts(documents(spark, sf_dir, "doc_id", "text"), "doc_id", merges)


@query
def q_bpe_decode(spark, sf_dir):
    """T6 + T10: decode the ids of every document; it round-trips when that gives its pre-tokenized words."""
    _, merges = trained_bpe(spark, sf_dir)
    vocab_size = len(BPE.SUBWORD_SPECIALS) + 256 + len(merges)
    d = documents(spark, sf_dir, "doc_id", "text")
    ids = BPE.encode_ids(d, merges).select("doc_id", F.md5(BPE.decode_ids(F.col("ids"), merges)).alias("decoded"))
    words = BPE.joined_words(d).select("doc_id", F.md5("joined").alias("joined"))
    return ids.join(words, "doc_id").select(
        "doc_id", (F.col("decoded") == F.col("joined")).alias("round_trip"), F.lit(vocab_size).cast("long").alias("vocab_size")
    )


@query
def q_bpe_ids(spark, sf_dir):
    """T5 + T6 + T10: every document as ordered ids, and the texts that the ids give back with and without specials."""
    _, merges = trained_bpe(spark, sf_dir)
    d = BPE.encode_ids(documents(spark, sf_dir, "doc_id", "text"), merges)
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"),
        F.md5(BPE.decode_ids(F.col("ids"), merges)).alias("text_md5"), F.md5(BPE.decode_ids(F.col("ids"), merges, True)).alias("plain_md5"),
    )


@query
def q_token_stats(spark, sf_dir):
    _, merges = trained_bpe(spark, sf_dir)
    counts = BPE.doc_token_counts(documents(spark, sf_dir, "doc_id", "text"), "doc_id", merges)
    return C.length_stats(counts, F.col("n_tokens"), "tokens")


UNIGRAM_VOCAB = 2000
N_TIMES, ALPHA = 10, 0.2
#: The share of pieces that a round of the registered training keeps: fewer, larger steps than the surveyed trainer's.
UNIGRAM_SHRINK = 0.2


def trained_unigram(spark, sf_dir):
    train = lambda: UG.train_unigram(documents(spark, sf_dir, "text"), UNIGRAM_VOCAB, shrink=UNIGRAM_SHRINK, sub_iterations=1)
    return trained_once(spark, sf_dir, "unigram", train)


@query
def q_unigram_train(spark, sf_dir):
    """The vocabulary with ids and scores."""
    return trained_unigram(spark, sf_dir).select("id", "piece", F.round("score", 6).alias("score"))


@query
def q_unigram_encode(spark, sf_dir):
    """Every document as ordered ids, of which their number and digest."""
    ids = UG.encode_ids(documents(spark, sf_dir, "doc_id", "text"), trained_unigram(spark, sf_dir))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query
def q_unigram_sample(spark, sf_dir):
    """T9 + J6: every document N_TIMES, its words drawn from their n-best segmentations."""
    drawn = UG.sample_ids(documents(spark, sf_dir, "doc_id", "text"), trained_unigram(spark, sf_dir), N_TIMES, ALPHA)
    return drawn.select("doc_id", "rep", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


# ---------------------------------------------------------------- 10 LM: generation

MAX_NEW_TOKENS = 512


def context_model(spark, sf_dir):
    """L1 of the corpus, and its character codec."""
    ensure_checkpoint_dir(spark)
    codec = V.char_codec(doc_char_vocab(spark, sf_dir))
    return CL.context_model(CL.grams(documents(spark, sf_dir, "text")), len(codec)).checkpoint(), codec


@query
def q_context_model(spark, sf_dir):
    """L1: the variable-order model, all contexts of up to three characters."""
    m, _ = context_model(spark, sf_dir)
    return m.select("ctx", "token", F.col("n").cast("long").alias("n"), F.round("p", 6).alias("p"), F.round("backoff", 6).alias("backoff"))


@query
def q_context_perplexity(spark, sf_dir):
    """L2 + L3 + A14 with the variable-order model on the held-out benchmark (unknown characters dropped, J2)."""
    m, codec = context_model(spark, sf_dir)
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", codec.known(F.col("text")).alias("text"))
    held = CL.grams(b, "item_id").checkpoint()
    scored = held.join(CL.log_probability(held, m, len(codec)), ["history", "token"])
    per = scored.groupBy("item_id").agg(F.sum("n").cast("long").alias("n_chars"), (-F.sum(F.col("logp") * F.col("n")) / F.sum("n")).alias("loss"))
    return per.select("item_id", "n_chars", F.round("loss", 6).alias("loss"), F.round(F.exp("loss"), 6).alias("perplexity"))


def generated(spark, sf_dir):
    """The samples of this session: the batch and the report read the same."""
    return trained_once(spark, sf_dir, "samples", lambda: new_samples(spark, sf_dir).checkpoint())


def new_samples(spark, sf_dir):
    """L4 + V1: one sample per benchmark item that goes on from its text, EOS = newline, truncated sampling with the corpus's
    variable-order model."""
    m, codec = context_model(spark, sf_dir)
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    prompts = b.select(F.col("item_id").alias("sample_id"), F.right(codec.known(F.col("text")), F.lit(CL.ORDER)).alias("tail"))
    table = CL.candidates(m, prompts, TEMPERATURE, TOP_K, TOP_P)
    path = scratch(spark, "contexts")
    table.write.parquet(path)  # a file, so that the planner knows its size and broadcasts it only if it is small
    return CL.generate(prompts, spark.read.schema(table.schema).parquet(path), "\n", MAX_NEW_TOKENS)


@query
def q_generate_batch(spark, sf_dir):
    """L4 + L5: generate, evaluate every sample."""
    m = evaluate_frame(generated(spark, sf_dir), ["sample_id", "n_new", "done"])
    return m.select(
        F.col("sample_id").alias("item_id"), F.col("n_new").cast("long").alias("n_new"), F.col("done").alias("stopped"),
        "line_count", "valid_hendecasyllables", "rhyme_lines",
    )


@query
def q_generation_report(spark, sf_dir):
    """L5 + A13: the evaluation report over the generated samples."""
    return evaluation_report(evaluate_frame(generated(spark, sf_dir), ["sample_id"]))


# ---------------------------------------------------------------- 14 streaming


@query
def q_stream_ingest(spark, sf_dir):
    s = ST.stream_ingest(spark, sf_dir)
    return s.select("identifier", "creator", "title", "publication_date", "word_count", F.md5("text").alias("text_md5"))


@query
def q_stream_budget(spark, sf_dir):
    s = ST.stream_budget(spark, sf_dir, half_of_words(spark, sf_dir))
    return s.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("word_count").cast("long").alias("word_count"),
        F.col("words_before").cast("long").alias("words_before"), F.col("increment").cast("long").alias("increment"),
    )


@query
def q_stream_encode(spark, sf_dir):
    poems = verse_view(documents(spark, sf_dir, "doc_id", "text", "lang"))
    chars = tag_rhymes_frame(poems.select(X.markup(F.col("text")).alias("m")), "m", "t", with_suffix=True).select(X.to_special_chars(F.col("t")).alias("text"))
    path = scratch(spark, "vocabulary")
    V.char_vocab(chars, special_chars=False).write.parquet(path)
    return ST.stream_encode(spark, sf_dir, path).drop("batch_id")


@query
def q_stream_eval(spark, sf_dir):
    return ST.stream_eval(spark, sf_dir)


@query
def q_stream_years(spark, sf_dir):
    return ST.stream_years(spark, sf_dir)


# ---------------------------------------------------------------- 7 vocab: syllables
def syllable_vocabulary(spark, sf_dir):
    """A8 + U4 over the marked-up verse (markers are whole tokens)."""
    ensure_checkpoint_dir(spark)
    v = verse(spark, sf_dir)
    toks = v.select(F.explode(F.array_distinct(Y.syllabify_text(X.markup(F.col("text"))))).alias("token"))
    return V.syllable_vocab(toks)


@query
def q_syllable_vocab(spark, sf_dir):
    voc = syllable_vocabulary(spark, sf_dir)
    return voc.select("token", F.col("id").cast("int").alias("id"))


@query
def q_syllable_encode(spark, sf_dir):
    """J2 + T3: held-out benchmark texts encoded with the verse syllable
    vocabulary; unknown tokens are dropped (not mapped to <UNK>)."""
    voc = syllable_vocabulary(spark, sf_dir)
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    first = b.agg(F.min("item_id")).first()[0]
    t = F.when(F.col("item_id") == F.lit(first), F.col("text")).otherwise(F.concat(F.lit("\n"), "text"))
    toks = b.select("item_id", F.explode(Y.syllabify_text(t)).alias("token"))
    enc = V.encode_join(toks, voc, strict=False)
    known = enc.groupBy("item_id").agg(F.count(F.lit(1)).cast("long").alias("n_tokens"), F.sum("id").cast("long").alias("id_sum"))
    total = toks.groupBy("item_id").agg(F.count(F.lit(1)).cast("long").alias("n_all"))
    return total.join(known, "item_id", "left").select(
        "item_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("id_sum", F.lit(0)).alias("id_sum"),
        (F.col("n_all") - F.coalesce("n_tokens", F.lit(0))).alias("n_dropped"),
    )


@query
def q_syllable_streams(spark, sf_dir):
    """The marked-up verse as two streams of syllable ids in shuffle order, a newline before every poem but
    the first of a split; written, read back and placed by what was written."""
    voc = syllable_vocabulary(spark, sf_dir)
    named = F.concat_ws("-", "doc_id", "poem_no").alias("key")
    poems = verse(spark, sf_dir).select(named, "doc_id", "poem_no", X.markup(F.col("text")).alias("m"))
    order = P.stream_order(verse(spark, sf_dir).select(named), "key")
    text = F.when(F.col("first"), F.col("m")).otherwise(F.concat(F.lit("\n"), F.col("m")))
    told = ["doc_id", "poem_no", "rank", "split"]
    toks = poems.join(order, "key").select(*told, F.posexplode(Y.syllabify_text(text)).alias("pos", "token"))
    known = V.encode_join(toks, voc, strict=False)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])  # of one poem, 84 words
    path = files.folder(spark, "streams")
    # the syllables of a corpus are more than 16 bits can number: 0.1 GB of documents has over 65,536 distinct tokens
    IO.write_streams(known.groupBy(*told).agg(ids.alias("ids")), path, bits=32)
    back = IO.read_streams(spark, path)
    sized = back.select(*told[:3], F.col("split").cast("string").alias("split"), F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))
    return P.stream_starts(sized).select("doc_id", "poem_no", "split", "start", F.col("n").alias("n_tokens"), "ids_md5")


@query
def q_syllable_tokens_tagged(spark, sf_dir):
    """Y7 + Y8 on tagged text: markers whole, the rhyme suffix a token of its own."""
    v = verse(spark, sf_dir).select("doc_id", "poem_no", X.markup(F.col("text")).alias("m"))
    t = tag_rhymes_frame(v, "m", "tagged", with_suffix=True).withColumn("toks", Y.syllabify_text(F.col("tagged")))
    return t.select("doc_id", "poem_no", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", "\u001f")).alias("tokens_md5"))


@query
def q_syllable_id_lookup(spark, sf_dir):
    """J4 with a vocabulary that holds <UNK>: every syllable token of the benchmark, unknown ones at its id."""
    toks = read_table(spark, sf_dir, "benchmark", "text").select(F.explode(F.array_distinct(Y.syllabify_text(F.col("text")))).alias("token")).distinct()
    return V.token_id(toks, syllable_vocabulary(spark, sf_dir)).select("token", F.col("id").cast("int").alias("id"))


@query
def q_finetune_titles(spark, sf_dir):
    """C18 with file names that have no number, and so no title, for every third document."""
    d = documents(spark, sf_dir, "doc_id", "lang")
    name = F.concat(F.lit("["), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("].txt"))
    return d.select("doc_id", X.finetune_title(F.when(F.col("doc_id") % 3 == 0, name).otherwise(F.concat(F.lit("7. "), name))).alias("title"))


# ---------------------------------------------------------------- 15 metadata sinks


@query
def q_dataset_metadata(spark, sf_dir):
    """Dataset, vocabulary size and tokens per split (flattened for the twin)."""
    vsize = doc_char_vocab(spark, sf_dir).count()
    per_split = q_split_tokens(spark, sf_dir)
    m = IO.dataset_metadata(per_split, "documents", vsize)
    return m.select("dataset", F.col("vocab_size").cast("long").alias("vocab_size"), "splits.train_tokens", "splits.val_tokens")


@query
def q_run_summary(spark, sf_dir):
    """Best validation loss, its step and the last step per run."""
    s = IO.run_summary(RL.eval_rows(run_steps(spark, sf_dir), EVAL_EVERY))
    return s.select(
        F.col("user_id").alias("run_id"), F.round("best_val_loss", 6).alias("best_val_loss"),
        F.col("best_step").cast("long").alias("best_step"), F.col("steps_done").cast("long").alias("steps_done"),
    )


@query
def q_unigram_seed(spark, sf_dir):
    """T7 seeding: the substrings of the distinct marked words that occur twice or more, weighted by frequency, and all
    single characters (of more than SEEDS those with the largest product of count and length, ties by piece)."""
    words = UG.word_freqs(documents(spark, sf_dir, "text")).where(~F.col("word").isin(*UG.USER_SYMBOLS))
    seeds = UG.seed_pieces(words)
    return seeds.select("piece", F.col("count").cast("long").alias("count"))
