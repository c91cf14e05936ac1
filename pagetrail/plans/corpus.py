"""Queries of the corpus operators over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.operators import corpus as C

from .registry import query
from .tables import POST, TOK, messages, sections, table, tokens

#: A page marker before every third line of a document.
_MARKED = r"""SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"""


def _raw_pages(spark, d):
    """Documents with a marker line before every third line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("-- "), (F.floor(i / 3) + 1).cast("string"), F.lit(" of 99 --\n"), x)).otherwise(x))
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(lines, "\n").alias("text"))


@query(f"""WITH l AS ({_MARKED}), m AS (SELECT doc, line, pos, (pos - 1) // 3 + 1 AS page_number FROM l WHERE pos >= 1)
    SELECT doc, page_number::INT AS page_number, string_agg(line, chr(10) ORDER BY pos) AS content FROM m GROUP BY ALL""")
def b1_split_pages(spark, d):
    return C.split_pages(_raw_pages(spark, d))


_SCRIPT_SQL = r"length(regexp_replace({w}, '[^\x{{0530}}-\x{{058F}}\x{{FB00}}-\x{{FB17}}]', '', 'g')) * 1.0 / length({w})"
_LATIN_SQL = r"length(regexp_replace({w}, '[^\x{{0041}}-\x{{007A}}\x{{00C0}}-\x{{024F}}]', '', 'g')) * 1.0 / length({w})"


@query(f"""WITH {TOK} SELECT word, CASE WHEN {_SCRIPT_SQL.format(w='word')} > 0.5 THEN 'armenian' WHEN {_LATIN_SQL.format(w='word')} > 0.5 THEN
    CASE WHEN regexp_matches(word, 'û|é|ô|oo|ts|dz|[bcdfghjklmnpqrstvwxz]{{2}}') THEN 'phonetic' ELSE 'english' END END AS script, count(*) AS n FROM tok GROUP BY ALL""")
def b2_classify_words(spark, d):
    return tokens(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.script_of(F.col("word")).alias("script"), "n")


@query(r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT CASE WHEN length(trim(line)) < 3 OR regexp_matches(line, '^\s*[\(\[]') THEN NULL
      WHEN regexp_matches(line, '(?i)\b(the|and|of|lord|with|for)\b') OR regexp_matches(line, '^(CHR|CLB|DCN|SRK)\.') THEN 'english' END AS section FROM l)
    SELECT section, count(*) AS n FROM c GROUP BY section""")
def b3_classify_lines(spark, d):
    lines = sections(spark, d).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.section_of(F.col("line")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


def _tagged(spark, d):
    tag = F.element_at(F.array(*[F.lit(t) for t in ("CHR", "CLB", "DCN", "SRK", "XYZ", "ՔՀՆ", "ԴՊՐ", "ՍՐԿ")]), (F.col("turn") % 8 + 1).cast("int"))
    return messages(spark, d).select(F.col("conv_id").alias("page_number"), F.col("turn").alias("pos"), F.concat(tag, F.lit(". "), F.coalesce("text", F.lit(""))).alias("line"))


@query("""WITH l AS (SELECT conv_id AS page_number, turn AS pos, ['choir', 'celebrant', 'deacon', 'deacon', NULL, 'celebrant', 'celebrant', 'deacon'][1 + turn % 8] AS speaker FROM conversations)
    SELECT page_number, arg_min(speaker, pos) AS main_speaker, list_sort(list(DISTINCT speaker)) AS speakers, count(DISTINCT speaker) > 1 AS multi_speaker
    FROM l WHERE speaker IS NOT NULL GROUP BY page_number""")
def b4_extract_speakers(spark, d):
    return C.extract_speakers(_tagged(spark, d))


# The folding in DuckDB's own terms: its accent stripping for all marks but those of the long u.
_PLAIN = "replace(replace(replace(replace(replace(lower(text), 'ﬔ', 'մե'), 'ﬕ', 'մի'), 'ﬗ', 'մխ'), 'ﬓ', 'մն'), 'ﬖ', 'վն')"
_FOLD = f"strip_accents(regexp_replace({_PLAIN}, '[ûùüú]', 'oo', 'g'))"


@query(f"""SELECT doc_id, trim(regexp_replace({_FOLD}, '[^a-z0-9\\x{{0530}}-\\x{{058F}}]+', ' ', 'g')) AS ngram, trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) AS live FROM documents""")
def b5_normalize_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.normalize_text(t).alias("ngram"), T.normalize_text(t, profile="live").alias("live"))


@query(r"SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))), 1, 16) AS page_id FROM documents")
def b6_page_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_id(F.col("text")).alias("page_id"))


@query(f"WITH {TOK} SELECT page, lang, pos::INT AS pos, word FROM tok")
def b7_tokenize(spark, d):
    return tokens(spark, d)


@query(f"WITH {TOK} SELECT page, pos::INT AS pos, word, lag(word) OVER w AS before, lead(word) OVER w AS after FROM tok WINDOW w AS (PARTITION BY page ORDER BY pos)")
def b8_with_context(spark, d):
    return C.with_context(tokens(spark, d).select("page", "pos", "word"))


@query(f"""WITH {TOK}, l AS (SELECT page, list(word ORDER BY pos) AS ws FROM tok GROUP BY page), g AS (SELECT page, unnest(CASE WHEN len(ws) <= 2 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gram FROM l) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def b9_ngrams(spark, d):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 2)
    listed = sections(spark, d).select(words.alias("ws"))
    return listed.select(F.explode(T.ngrams(F.col("ws"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(text, 'ﬓ', 'մն'), 'ﬔ', 'մե'), 'ﬕ', 'մի'), 'ﬖ', 'վն'), 'ﬗ', 'մխ'), 'և', 'եւ') AS text FROM documents")
def b10_decompose_ligatures(spark, d):
    return table(spark, d, "documents").select("doc_id", T.decompose_ligatures(F.col("text")).alias("text"))


@query()
def b11_transliterate(spark, d):
    return tokens(spark, d).select("word").distinct().withColumn("phonetic", T.transliterate(F.col("word")))


@query(rf"""WITH {TOK}, s AS (SELECT word, regexp_extract_all(word, '[^aeiouy]*[aeiouy]') AS c, regexp_extract(word, '([^aeiouy]*)$', 1) AS rest FROM (SELECT DISTINCT word FROM tok))
    SELECT word, CASE WHEN len(c) = 0 THEN [word] ELSE list_append(c[1 : len(c) - 1], c[len(c)] || rest) END AS syllables FROM s""")
def b12_split_syllables(spark, d):
    return tokens(spark, d).select("word").distinct().select("word", T.split_syllables(F.col("word")).alias("syllables"))


@query(f"WITH {TOK}, w AS (SELECT word, count(*) AS n FROM tok GROUP BY word), l AS (SELECT unnest(string_split(word, '')) AS letter, n FROM w) SELECT letter, count(*) AS plain, sum(n)::BIGINT AS weighted FROM l WHERE letter <> '' GROUP BY letter")
def b13_letter_frequency(spark, d):
    words = tokens(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    letters = words.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("letter"), "n")
    return letters.groupBy("letter").agg(F.count(F.lit(1)).alias("plain"), F.sum("n").alias("weighted"))


@query(f"WITH {TOK}, c AS (SELECT page, pos::INT AS pos, word, lag(word) OVER w AS before, lead(word) OVER w AS after FROM tok WINDOW w AS (PARTITION BY page ORDER BY pos)) SELECT * FROM c WHERE word = 'with'")
def b14_find_word(spark, d):
    return C.find_word(tokens(spark, d).select("page", "pos", "word"), "with")


def _words(spark, d):
    t = tokens(spark, d).groupBy("word", "lang").agg(F.count(F.lit(1)).alias("occurrences"), F.min("page").alias("page"))
    return t.select(F.col("word").alias("armenian"), F.col("lang").alias("phonetic"), "occurrences", F.round(F.least(F.lit(1.0), F.col("occurrences") / 10), 4).alias("confidence"), "page")


_WORDS = f"{TOK}, words AS (SELECT word AS armenian, lang AS phonetic, count(*) AS occurrences, round(least(1.0, count(*) / 10.0), 4)::DOUBLE AS confidence, min(page) AS page FROM tok GROUP BY word, lang)"


@query(f"WITH {_WORDS} SELECT * FROM words WHERE occurrences > 3 AND (contains(lower(armenian), 'er') OR contains(lower(phonetic), 'er')) ORDER BY occurrences DESC, armenian, phonetic LIMIT 50 OFFSET 50")
def b15_browse_dictionary(spark, d):
    return C.browse_dictionary(_words(spark, d), filter="common", sort="frequency", page=2, limit=50, search="er")


@query(f"WITH {_WORDS} SELECT sum(occurrences)::BIGINT AS total, count(DISTINCT armenian) AS distinct_words, count(*) FILTER (occurrences > 3) AS common, count(*) FILTER (occurrences = 1) AS rare, count(DISTINCT page) AS pages FROM words")
def b15_dictionary_stats(spark, d):
    return C.dictionary_stats(_words(spark, d))


_PHRASES = r"p AS (SELECT DISTINCT doc_id AS page, trim(unnest(regexp_split_to_array(lower(text), '[.!?]'))) AS phrase FROM documents), i AS (SELECT phrase, page // 4096 AS block, list(page ORDER BY page) AS pages FROM p WHERE length(phrase) >= 11 GROUP BY ALL)"


@query(f"WITH {_PHRASES} SELECT * FROM i")
def b16_phrase_index(spark, d):
    return C.phrase_index(sections(spark, d))


@query(rf"WITH {_PHRASES}, q AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(lower(text), '[.!?]'))) AS phrase FROM benchmark) SELECT phrase, unnest(pages) AS page FROM i JOIN q USING (phrase)")
def b16_find_phrase(spark, d):
    asked = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[.!?]")).alias("phrase")).select(F.trim("phrase").alias("phrase"))
    return C.find_phrase(C.phrase_index(sections(spark, d)), asked)


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(the|and|of|lord|with|for)\b') THEN 'english' ELSE 'phonetic' END AS language FROM documents")
def b17_detect_language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


def _three(spark, d):
    by = lambda lang: F.when(F.col("lang") == lang, F.col("text")).otherwise("")
    return table(spark, d, "documents").select(F.col("source").alias("pdf_id"), F.col("doc_id").alias("page_number"), by("de").alias("armenian_text"), by("fr").alias("phonetic_text"), by("en").alias("english_text"))


@query("""SELECT doc_id AS page_number, CASE WHEN lang IN ('de', 'fr', 'en') THEN nullif(trim(text), '') END AS text,
    CASE WHEN trim(text) = '' THEN NULL ELSE CASE lang WHEN 'de' THEN 'grapar' WHEN 'fr' THEN 'phonetic' WHEN 'en' THEN 'english' END END AS language FROM documents""")
def b18_fallback_text(spark, d):
    return C.fallback_text(_three(spark, d))


@query("SELECT source AS pdf_id, doc_id AS page_number FROM documents WHERE source = 'src3' UNION ALL SELECT * FROM (SELECT source AS pdf_id, doc_id AS page_number FROM documents ORDER BY doc_id, source LIMIT 183) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src3')")
def b19_sections_or_default(spark, d):
    return C.sections_or_default(_three(spark, d).select("pdf_id", "page_number"), pdf_id="src3")


@query("SELECT source AS pdf_id, doc_id AS page_number FROM documents ORDER BY doc_id, source LIMIT 183")
def b19_sections_of_any(spark, d):
    return C.sections_or_default(_three(spark, d).select("pdf_id", "page_number"), pdf_id="no such book")


@query(r"SELECT doc_id, substr(text, 1, 50) AS text_key, array_to_string(regexp_extract_all(text, '[^ \t\n\r\f\v]+')[1:5], ' ') AS text_words FROM documents")
def b20_preview(spark, d):
    return C.preview(table(spark, d, "documents").select("doc_id", "text"), ["text"]).drop("text")


@query("""SELECT event_id, CASE WHEN c AND s > 0.9 THEN 'speaker change, strong match' WHEN c THEN 'speaker change' WHEN s > 0.9 THEN 'strong match' WHEN s > 0.75 THEN 'match' ELSE 'weak match' END AS reason
    FROM (SELECT event_id, event_type = 'click' AS c, least(value / 50.0, 1.0) AS s FROM events)""")
def b21_explain_advance(spark, d):
    return table(spark, d, "events").select("event_id", T.explain_advance(F.least(F.col("value") / 50.0, F.lit(1.0)), F.col("event_type") == "click").alias("reason"))


@query("SELECT event_id, greatest(1, least(50, CAST(json_extract(props, '$.k') AS INT))) AS page FROM events")
def b22_clamp(spark, d):
    return table(spark, d, "events").select("event_id", T.clamp(F.get_json_object("props", "$.k").cast("int"), 1, 50).alias("page"))


# Latin words that the index of sounds leaves out.
LATIN_STOP = ("the", "and", "of", "to", "in", "a", "is", "for", "on", "at")
_STOP = ", ".join(f"'{w}'" for w in LATIN_STOP)
_INDEXED = f"{TOK}, ix AS (SELECT DISTINCT lang, word, page FROM tok WHERE length(word) >= CASE lang WHEN 'en' THEN 3 ELSE 2 END AND NOT (lang = 'es' AND word IN ({_STOP})))"


def _indexed(spark, d):
    """English words have three letters at least, stop words are left out of one language, and another's sounds are added to it (there are
    none of Latin letters)."""
    return C.index_words(tokens(spark, d), least={"en": 3}, stop={"es": LATIN_STOP}, sounds={"de": "es"})


@query(f"WITH {_INDEXED} SELECT lang, word, page // 4096 AS block, list_sort(list(page)) AS pages FROM ix GROUP BY lang, word, page // 4096")
def d1_inverted_index(spark, d):
    return C.build_inverted_index(_indexed(spark, d))


@query(f"WITH {_INDEXED} SELECT lang, word, min(page) AS first_page, count(*) AS df FROM ix GROUP BY lang, word")
def d1_index_totals(spark, d):
    return C.index_totals(_indexed(spark, d))


@query(f"""WITH {TOK}, t AS (SELECT word, min(page) AS first_page, count(*) AS occurrences, count(DISTINCT page) AS page_count FROM tok GROUP BY word),
    b AS (SELECT word, page // 4096 AS block, count(*) AS block_occurrences, list_sort(list(DISTINCT page)) AS pages FROM tok GROUP BY word, page // 4096)
    SELECT word, block, first_page, occurrences, page_count, block_occurrences, pages FROM b JOIN t USING (word)""")
def d2_dictionary(spark, d):
    return C.build_dictionary(tokens(spark, d))


@query(f"WITH {TOK} SELECT word, page // 4096 AS block, list_sort(list(DISTINCT page)) AS pages FROM tok GROUP BY word, page // 4096")
def d2_dictionary_pages(spark, d):
    return C.dictionary_pages(tokens(spark, d))


_PAIRS = f"{TOK}, pairs AS (SELECT page AS page_number, pos, word AS armenian, lead(word) OVER (PARTITION BY page ORDER BY pos) AS phonetic FROM tok)"


def _pairs(spark, d):
    t = C.with_context(tokens(spark, d).select("page", "pos", "word"))
    return t.select(F.col("page").alias("page_number"), "pos", F.col("word").alias("armenian"), F.col("after").alias("phonetic"))


@query(f"WITH {_PAIRS} SELECT armenian, phonetic, min(page_number) AS page_number, count(*) AS occurrences FROM pairs GROUP BY armenian, phonetic")
def d3_unique_pairs(spark, d):
    return C.unique_pairs(_pairs(spark, d))


@query(f"""WITH {TOK}, {POST}, n AS (SELECT page, count(DISTINCT word) AS n FROM tok GROUP BY page)
    SELECT (SELECT count(*) FROM df) AS unique_words, (SELECT sum(df)::BIGINT FROM df) AS total, (SELECT round(avg(df), 4) FROM df) AS avg_per_word, (SELECT count(*) FROM df WHERE df <= 3) AS rare_words,
    round(avg(n), 4) AS avg_words_per_page, min(n) AS min_words_per_page, max(n) AS max_words_per_page FROM n""")
def d4_index_stats(spark, d):
    t = tokens(spark, d)
    return C.index_stats(C.postings(t), t)


@query(f"""WITH {_PAIRS}, c AS (SELECT armenian, phonetic, count(*) AS n, row_number() OVER (PARTITION BY armenian ORDER BY count(*) DESC, phonetic) AS r FROM pairs WHERE phonetic IS NOT NULL GROUP BY armenian, phonetic)
    SELECT armenian, min(phonetic) FILTER (r = 1) AS primary_form, coalesce(list(phonetic ORDER BY r) FILTER (r IN (2, 3)), []) AS alternatives, min(n) FILTER (r = 1) AS frequency FROM c WHERE r <= 3 GROUP BY armenian""")
def d5_dominant_phonetic(spark, d):
    return C.dominant_phonetic(_pairs(spark, d).where("phonetic is not null"))


@query(f"""WITH {TOK}, {POST}, s AS (SELECT page, count(*) FILTER (df <= 3) AS rare_words, count(*) FILTER (df > 10) AS common_words, count(*) AS unique_words FROM post JOIN df USING (word) GROUP BY page)
    SELECT page, rare_words, common_words, unique_words, (SELECT count(*) FROM tok WHERE tok.page = s.page) AS total_words, round(rare_words / unique_words, 6) AS uniqueness FROM s""")
def d6_page_signature(spark, d):
    t = tokens(spark, d)
    return C.page_signature(t, C.postings(t))


_ZIP = r"""w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) >= 2) AS ws FROM documents),
    z AS (SELECT a.doc_id AS page, least(len(a.ws), len(b.ws)) AS n, a.ws AS l, b.ws AS r FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)"""


@query(f"WITH {_ZIP} SELECT page, unnest(range(1, n + 1))::INT AS pos, unnest(l[1:n]) AS left_word, unnest(r[1:n]) AS right_word FROM z WHERE n > 0")
def c11_zip_words(spark, d):
    t = tokens(spark, d).select("page", "pos", "word")
    return C.zip_words(t.where("page % 2 = 0"), t.where("page % 2 = 1").withColumn("page", F.col("page") - 1))


@query(r"""WITH RECURSIVE l AS (SELECT conv_id AS doc, turn AS pos, CASE turn % 3 WHEN 0 THEN 'CHR. ' || lower(coalesce(text, '')) WHEN 2 THEN 'CHR. ' || 'Տէր ' || coalesce(text, '') ELSE text END AS line FROM conversations),
    w AS (SELECT line, lead(line, 2) OVER (PARTITION BY doc ORDER BY pos) AS later FROM l),
    m AS (SELECT regexp_split_to_array(trim(regexp_replace(line, '^[A-Z]{3}\. ', '')), '\s+') AS p, regexp_split_to_array(trim(regexp_replace(later, '^[A-Z]{3}\. ', '')), '\s+') AS a FROM w
          WHERE regexp_matches(line, '^[A-Z]{3}\. [a-z]') AND regexp_matches(later, '^[A-Z]{3}\. (?s:.)*[\x{0530}-\x{058F}]'))
    SELECT unnest(a[1 : least(len(a), len(p))]) AS armenian, unnest(p[1 : least(len(a), len(p))]) AS phonetic FROM m""")
def c12_phonetic_triples(spark, d):
    m, text = messages(spark, d), F.coalesce("text", F.lit(""))
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("CHR. "), F.lower(text))).when(F.col("turn") % 3 == 2, F.concat(F.lit("CHR. Տէր "), text)).otherwise(F.col("text"))
    return C.phonetic_triples(m.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), line.alias("line")))


@query(f"WITH {TOK} SELECT word, count(*) AS n FROM tok GROUP BY word ORDER BY n DESC, word LIMIT 30")
def j2_top_words(spark, d):
    return tokens(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(30)


@query("SELECT doc_id, source, ceil((SELECT count(*) FROM documents) / 50.0)::BIGINT AS total_pages FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def j3_paginate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    total = docs.agg(F.ceil(F.count(F.lit(1)) / 50).alias("total_pages"))
    return docs.orderBy("doc_id").offset(100).limit(50).join(F.broadcast(total))


@query("SELECT DISTINCT source FROM documents UNION SELECT role FROM conversations")
def j4_union(spark, d):
    return table(spark, d, "documents").select("source").unionByName(messages(spark, d).select(F.col("role").alias("source"))).distinct()


@query(f"WITH {TOK} (SELECT word FROM tok WHERE lang = 'en' INTERSECT SELECT word FROM tok WHERE lang = 'fr') EXCEPT SELECT word FROM tok WHERE lang = 'es'")
def j5_vocabularies(spark, d):
    t = tokens(spark, d)
    of = lambda lang: t.where(F.col("lang") == lang).select("word")
    return of("en").intersect(of("fr")).subtract(of("es"))


@query("SELECT DISTINCT source, lang FROM documents")
def j6_distinct(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def j1_ordered(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 100000").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")
