"""Corpus operators: pages, words, dictionaries, inverted indexes and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as T


def split_pages(raw: DataFrame, *, marker: str = r"-- (\d+) of \d+ --") -> DataFrame:
    """``doc, page_number, content``: lines between marker lines; those before the first are dropped. Works within a document."""
    lines = raw.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    no = F.regexp_extract("line", marker, 1)
    lines = lines.withColumn("mark", F.when(no != "", no.cast("int"))).withColumn("page_number", F.last("mark", ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos")))
    body = lines.where("page_number is not null and mark is null")
    return body.groupBy("doc", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


def extract_speakers(lines: DataFrame, *, tags: dict[str, str] = T.SPEAKER_TAGS) -> DataFrame:
    """``page_number, main_speaker, speakers, multi_speaker`` from lines ``page_number, pos, line`` that start with a tag and a dot."""
    tag = F.regexp_extract("line", "^(" + "|".join(tags) + r")\.", 1)
    names = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    said = lines.withColumn("speaker", names[tag]).where("speaker is not null")
    out = said.groupBy("page_number").agg(F.min_by("speaker", "pos").alias("main_speaker"), F.sort_array(F.collect_set("speaker")).alias("speakers"))
    return out.withColumn("multi_speaker", F.size("speakers") > 1)


def with_context(tokens: DataFrame) -> DataFrame:
    """Each word of ``page, pos, word`` with the words before and after it on its page."""
    w = Window.partitionBy("page").orderBy("pos")
    return tokens.withColumn("before", F.lag("word").over(w)).withColumn("after", F.lead("word").over(w))


def letter_frequency(words: DataFrame, *, weight: str | None = None) -> DataFrame:
    letters = words.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("letter"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    return letters.groupBy("letter").agg(F.sum("n").alias("count"))


def find_word(tokens: DataFrame, word: str) -> DataFrame:
    """Occurrences of a word with their context; the filter comes after the neighbours are known."""
    return with_context(tokens).where(F.col("word") == word)


def browse_dictionary(words: DataFrame, *, filter: str = "all", sort: str = "alphabetical", page: int = 1, limit: int = 100, search: str | None = None) -> DataFrame:
    """A page of ``armenian, phonetic, occurrences, confidence``: common has over 3 occurrences, rare 1, high confidence 0.9, low under 0.5."""
    keep = {"all": F.lit(True), "common": F.col("occurrences") > 3, "rare": F.col("occurrences") == 1, "high": F.col("confidence") >= 0.9, "low": F.col("confidence") < 0.5}[filter]
    if search:
        keep = keep & (F.lower("armenian").contains(search.lower()) | F.lower("phonetic").contains(search.lower()))
    order = {"alphabetical": [F.asc("armenian")], "frequency": [F.desc("occurrences"), F.asc("armenian")], "confidence": [F.desc("confidence"), F.asc("armenian")]}[sort]
    return words.where(keep).orderBy(*order, "phonetic").offset((page - 1) * limit).limit(limit)


def dictionary_stats(words: DataFrame) -> DataFrame:
    return words.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total"), F.countDistinct("armenian").alias("distinct_words"), F.count_if(F.col("occurrences") > 3).alias("common"), F.count_if(F.col("occurrences") == 1).alias("rare"), F.countDistinct("page").alias("pages"))


#: Page numbers that a block of an index spans: a row holds that many pages at most, however common its word.
BLOCK = 4096


def _blocks(post: DataFrame, keys: list[str], span: int) -> DataFrame:
    """The keys, ``block`` and the sorted pages of each block."""
    block = F.floor(F.col("page") / span).cast("long")
    return post.withColumn("block", block).groupBy(*keys, "block").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def phrase_index(pages: DataFrame, *, split: str = r"[.!?]", min_len: int = 11, span: int = BLOCK) -> DataFrame:
    """``phrase, block, pages``: trimmed lower-case phrases of ``min_len`` characters or more, with their distinct pages in order, a row for
    each block of ``span`` page numbers."""
    phrases = pages.select("page", F.explode(F.split(F.lower("text"), split)).alias("phrase")).select("page", F.trim("phrase").alias("phrase"))
    return _blocks(phrases.where(F.length("phrase") >= min_len).distinct(), ["phrase"], span)


def find_phrase(index: DataFrame, phrases: DataFrame) -> DataFrame:
    return index.join(phrases.select("phrase").distinct(), "phrase").select("phrase", F.explode("pages").alias("page"))


def fallback_text(sections: DataFrame) -> DataFrame:
    """``page_number, text, language``: the first of three languages that has text."""
    g, p, e = (F.nullif(F.trim(c), F.lit("")) for c in ("armenian_text", "phonetic_text", "english_text"))
    return sections.select("page_number", F.coalesce(g, p, e).alias("text"), F.when(g.isNotNull(), "grapar").when(p.isNotNull(), "phonetic").when(e.isNotNull(), "english").alias("language"))


def sections_or_default(sections: DataFrame, *, pdf_id: str, limit: int = 183) -> DataFrame:
    """The rows of a book; if it has none, the first ``limit`` rows of any book by page, then book. One pass decides both."""
    own = sections.where(F.col("pdf_id") == pdf_id)
    first = sections.orderBy("page_number", "pdf_id").limit(limit)
    has = own.limit(1).agg((F.count(F.lit(1)) > 0).alias("_has"))
    return own.unionByName(first.join(F.broadcast(has.where("not _has")), how="inner").drop("_has"))


def preview(df: DataFrame, cols: list[str], *, chars: int = 50, words: int = 5) -> DataFrame:
    for c in cols:
        df = df.withColumn(f"{c}_key", F.substring(c, 1, chars)).withColumn(f"{c}_words", F.array_join(F.slice(F.regexp_extract_all(F.col(c), F.lit(r"\S+"), F.lit(0)), 1, words), " "))
    return df


def postings(tokens: DataFrame) -> DataFrame:
    """Distinct ``word, page``; duplicates are dropped before they shuffle."""
    return tokens.select("word", "page").distinct()


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def index_words(tokens: DataFrame, *, least: dict[str, int] | None = None, stop: dict[str, tuple[str, ...]] | None = None, sounds: dict[str, str] | None = None) -> DataFrame:
    """Distinct ``lang, word, page`` of an index by language: words shorter than ``least`` (2 where it says nothing) and the words ``stop`` are
    left out; the sounds of the words of a language are indexed under that which ``sounds`` names, unless they are under two letters."""
    least, stop = least or {}, stop or {}
    rows = tokens.select("lang", "word", "page")
    short = F.lit(2)
    for lang, n in least.items():
        short = F.when(F.col("lang") == lang, n).otherwise(short)
    kept = F.length("word") >= short
    for lang, words in stop.items():
        kept &= ~((F.col("lang") == lang) & F.col("word").isin(*words))
    out = rows.where(kept).distinct()
    for lang, to in (sounds or {}).items():
        known = out.where(F.col("lang") == lang)
        sound = known.select("word").distinct().withColumn("_sound", F.lower(T.transliterate(F.col("word")))).where(F.length("_sound") >= 2)
        out = out.unionByName(known.join(sound, "word").select(F.lit(to).alias("lang"), F.col("_sound").alias("word"), "page"))
    return out.distinct() if sounds else out


def build_inverted_index(indexed: DataFrame, *, span: int = BLOCK) -> DataFrame:
    """``lang, word, block, pages`` from :func:`index_words`: a row for each block of ``span`` page numbers that a word is in."""
    return _blocks(indexed.select("lang", "word", "page"), ["lang", "word"], span)


def index_totals(indexed: DataFrame) -> DataFrame:
    """``lang, word, first_page, df``: a row a word, its pages counted over all blocks."""
    return indexed.groupBy("lang", "word").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("df"))


def build_dictionary(tokens: DataFrame, *, span: int = BLOCK) -> DataFrame:
    """``word, block, first_page, occurrences, page_count, block_occurrences, pages``: a row for each block of ``span`` page numbers that a
    word is in, with its sorted pages and its occurrences there; the first page, occurrences and pages counted are the word's over all blocks."""
    dealt = tokens.select("word", "page", F.floor(F.col("page") / span).cast("long").alias("block")).repartition("word", "block")
    by_page = dealt.groupBy("word", "block", "page").agg(F.count(F.lit(1)).alias("n"))
    blocks = by_page.groupBy("word", "block").agg(F.sum("n").alias("block_occurrences"), F.sort_array(F.collect_list("page")).alias("pages"))
    whole = Window.partitionBy("word")  # a row a block
    first, page_count = F.min(F.get("pages", F.lit(0))).over(whole), F.sum(F.size("pages")).over(whole)
    return blocks.select("word", "block", first.alias("first_page"), F.sum("block_occurrences").over(whole).alias("occurrences"), page_count.alias("page_count"), "block_occurrences", "pages")


def dictionary_pages(tokens: DataFrame, *, span: int = BLOCK) -> DataFrame:
    """``word, block, pages``: the pages of each word, a row for each block of ``span`` page numbers."""
    return _blocks(tokens.select("word", "page").distinct(), ["word"], span)


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """``armenian, phonetic, page_number, occurrences``: pairs with counts and the page where they are first seen."""
    return pairs.groupBy("armenian", "phonetic").agg(F.min_by("page_number", F.struct("page_number", "pos")).alias("page_number"), F.count(F.lit(1)).alias("occurrences"))


def index_stats(post: DataFrame, tokens: DataFrame) -> DataFrame:
    df = document_frequency(post)
    words = df.agg(F.count(F.lit(1)).alias("unique_words"), F.sum("df").alias("total"), F.round(F.avg("df"), 4).alias("avg_per_word"), F.count_if(F.col("df") <= 3).alias("rare_words"))
    pages = tokens.groupBy("page").agg(F.countDistinct("word").alias("n")).agg(F.round(F.avg("n"), 4).alias("avg_words_per_page"), F.min("n").alias("min_words_per_page"), F.max("n").alias("max_words_per_page"))
    return words.join(F.broadcast(pages))


def dominant_phonetic(pairs: DataFrame) -> DataFrame:
    """``armenian, primary_form, alternatives, frequency``: each word's commonest form and the next two."""
    counted = pairs.groupBy("armenian", "phonetic").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("armenian").orderBy(F.desc("n"), "phonetic"))).where("r <= 3")
    out = best.groupBy("armenian").agg(F.min_by("phonetic", "r").alias("primary_form"), F.min_by("n", "r").alias("frequency"), F.sort_array(F.collect_list(F.struct("r", "phonetic"))).alias("all"))
    return out.select("armenian", "primary_form", F.transform(F.slice("all", 2, 2), lambda x: x["phonetic"]).alias("alternatives"), "frequency")


def page_signature(tokens: DataFrame, post: DataFrame, *, rare: int = 3, common: int = 10) -> DataFrame:
    """Counts of a page's distinct words that are rare or common in the book, its totals, and the share of rare ones."""
    df = document_frequency(post)
    told = post.join(df, "word").groupBy("page").agg(F.count_if(F.col("df") <= rare).alias("rare_words"), F.count_if(F.col("df") > common).alias("common_words"), F.count(F.lit(1)).alias("unique_words"))
    total = tokens.groupBy("page").agg(F.count(F.lit(1)).alias("total_words"))
    return told.join(total, "page").withColumn("uniqueness", F.round(F.col("rare_words") / F.col("unique_words"), 6))


def rarity_weight(df: Column) -> Column:
    return F.when(df <= 3, 10).when(df <= 10, 3).otherwise(1)


def zip_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """The i-th word of one side with the i-th of the other, page by page."""
    return left.select("page", "pos", F.col("word").alias("left_word")).join(right.select("page", "pos", F.col("word").alias("right_word")), ["page", "pos"])


def phonetic_triples(lines: DataFrame) -> DataFrame:
    """Words paired from a tagged phonetic line and the tagged script line two below it (``doc, pos, line``)."""
    w = Window.partitionBy("doc").orderBy("pos")
    tagged = r"^[A-Z]{3}\. "
    both = lines.withColumn("later", F.lead("line", 2).over(w)).where(F.col("line").rlike(tagged + "[a-z]") & F.col("later").rlike(tagged + r".*[\x{0530}-\x{058F}]"))
    strip = lambda c: F.split(F.trim(F.regexp_replace(c, tagged, "")), r"\s+")
    pairs = F.arrays_zip(strip("later").alias("armenian"), strip("line").alias("phonetic"))
    return both.select(F.explode(pairs).alias("p")).select("p.armenian", "p.phonetic").where("armenian is not null and phonetic is not null")
