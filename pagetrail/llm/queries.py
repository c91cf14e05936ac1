"""What the subpackage registers: ``QUERIES`` and, where SQL can express them, ``ORACLES`` (DuckDB)."""

from __future__ import annotations

from .class_lm import class_scores
from .common import documents, labels
from .conversations import repair_damaged
from .exact_dedup import exact_duplicates
from .gif import read_back, to_gif
from .licenses import scan_licences
from .merkle import verify_tampered
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import personal_data_digests
from .repeats import cut_repeats
from .sentencepiece_fst import round_trip
from .token_counts import count_tokens
from .toxicity import score_toxicity


def op1_gif(spark, sf_dir):
    """Every text stored as a GIF and read back frame by frame."""
    return read_back(to_gif(documents(spark, sf_dir)))


def op2_exact_dedup(spark, sf_dir):
    """The group of every text and which of its rows stays."""
    return exact_duplicates(documents(spark, sf_dir))


def op3_token_counts(spark, sf_dir):
    """Tokens of every text, as the library for the file counts them."""
    return count_tokens(documents(spark, sf_dir))


def op4_near_dedup(spark, sf_dir):
    """The component of every document by four-word shingles at 0.8."""
    return near_duplicates(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    """A calibrated score of every text, learned from the labels."""
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_licenses(spark, sf_dir):
    """The licence notices of every text."""
    return scan_licences(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    return mix_sources(documents(spark, sf_dir))


def op8_sentencepiece(spark, sf_dir):
    """Digests of every text encoded, and decoded again."""
    return round_trip(documents(spark, sf_dir))


def op9_repeats(spark, sf_dir):
    """What is left of every text without its repeated strings, as digests."""
    return cut_repeats(documents(spark, sf_dir)).drop("kept", "spans")


def op10_class_lm(spark, sf_dir):
    """Unigram and class-bigram scores of every text."""
    return class_scores(documents(spark, sf_dir))


def op11_conversations(spark, sf_dir):
    """Every conversation damaged and repaired: what was wrong, the cheapest edits and a digest of the result."""
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_pii(spark, sf_dir):
    """Personal data in every text: what base rules find, and what the model adds."""
    return personal_data_digests(documents(spark, sf_dir))


def op13_merkle(spark, sf_dir):
    """Every row's leaf, roots and proof, verified after some texts were tampered with."""
    return verify_tampered(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_gif, op2_exact_dedup, op3_token_counts, op4_near_dedup, op5_toxicity, op6_licenses, op7_mixing, op8_sentencepiece, op9_repeats, op10_class_lm, op11_conversations, op12_pii, op13_merkle)}



def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text: a step of the shift register for each bit."""
    return f"""xor(list_reduce(flatten(list_transform(range(0, length({text}) + 1), lambda i: CASE WHEN i = 0 THEN [4294967295::UBIGINT]
        ELSE [ascii(substr({text}, i, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0] END)),
        lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)"""


def _push(state: str, cost: int, letter: str) -> str:
    """SQL: an edit put before what is to come."""
    return f"(lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({state}, 10))"


def _least(stays: str, kept: str, changed: str) -> str:
    """SQL: the least of what may be done with the row ``r, fault``: deleted, kept, or given another role."""
    more = [_push(f"({x})", c, letter) for x, c, letter in ((kept, 0, "K"), (changed, 1, "R"))]
    late = [_push(f"({x})", c, letter) for x, c, letter in ((kept, 5, "K"), (changed, 6, "R"))]
    return f"""least({_push(stays, 2, "D")}, CASE WHEN fault = 'k' THEN least({more[0]}, {more[1]}) WHEN fault = 't' THEN least({late[0]}, {late[1]}) END)"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


ORACLES = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS sh FROM w),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT o.a, o.b FROM o JOIN s p ON p.doc_id = o.a JOIN s q ON q.doc_id = o.b WHERE 100 * shared >= 80 * (len(p.sh) + len(q.sh) - shared)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.d),
        m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON d = doc_id""",
    "op7_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
              FROM d GROUP BY source),
        fill(round, capped, source) AS (
            SELECT 0, n = 0, source FROM s
            UNION ALL
            SELECT round + 1, capped OR 3 * n * sum(CASE WHEN NOT capped THEN w END) OVER () > 0
                       AND 3 * n * coalesce(sum(CASE WHEN NOT capped THEN w END) OVER (), 0)
                           <= w * (sum(n) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * n END) OVER (), 0)), fill.source
            FROM fill JOIN s ON s.source IS NOT DISTINCT FROM fill.source WHERE round < 60),
        f AS (SELECT source, bool_or(capped) AS capped FROM fill WHERE round = 60 GROUP BY source),
        t AS (SELECT s.source, n, CASE WHEN capped THEN (3 * n)::DOUBLE
                  ELSE (w * (sum(n) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * n END) OVER (), 0)))::DOUBLE
                       / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
              FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source),
        r AS (SELECT doc_id, d.source, size, n, target, round(target)::BIGINT AS budget,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, n AS source_size, target, source,
               (CASE WHEN n = 0 THEN 0 ELSE budget // n * size + greatest(0, least(size, budget % n - ahead)) END)::BIGINT AS taken
        FROM r""",
    "op11_conversations": rf"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE kind <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                count(*) OVER (PARTITION BY conv_id) AS n FROM d),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS fault,
                CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS r FROM p),
        -- costs to come (nine digits) and letters to come, least first, of the four states: nothing yet, after s, after u, after a
        s AS (
            SELECT conv_id, max(n) + 1 AS i, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2, '000000000' AS v3 FROM f GROUP BY conv_id
            UNION ALL
            SELECT conv_id, i, least(w0, {_push("least(w2, " + _push("w3", 5, "I") + ")", 5, "I")}) AS v0,
                least(w1, {_push("least(w2, " + _push("w3", 5, "I") + ")", 5, "I")}) AS v1, least(w2, {_push("w3", 5, "I")}) AS v2,
                least(w3, {_push("w2", 5, "I")}) AS v3
            FROM (SELECT f.conv_id, f.i, {_least("v0", "CASE WHEN r = 's' THEN v1 WHEN r = 'u' THEN v2 END", "v2")} AS w0,
                {_least("v1", "CASE WHEN r = 'u' THEN v2 END", "v2")} AS w1, {_least("v2", "CASE WHEN r = 'a' THEN v3 END", "v3")} AS w2,
                {_least("v3", "CASE WHEN r = 'u' THEN v2 END", "v2")} AS w3
                FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1)),
        a AS (SELECT conv_id, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM s WHERE i = 1),
        e AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM a),
        x AS (SELECT conv_id, k, audit[k] AS letter, length(replace(left(audit, k), 'I', '')) AS i,
                length(replace(left(audit, k), 'D', '')) AS place FROM e),
        y AS (SELECT x.*, f.role, f.text, f.r, bool_or(letter = 'K' AND f.r = 's') OVER (PARTITION BY x.conv_id) AS led
              FROM x LEFT JOIN f ON x.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i),
        z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines FROM y WHERE letter <> 'D' GROUP BY conv_id),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal
              FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS bad FROM f) GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
            sha256(coalesce(lines, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_merkle": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
                CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
            FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        n AS (SELECT source, 0 AS level, i, leaf AS digest FROM p
            UNION ALL
            SELECT source, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM n) WHERE c > 1 GROUP BY source, level, i // 16),
        r AS (SELECT source, max_by(digest, level) AS subroot, max(level) AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM n GROUP BY source),
        t AS (SELECT 0 AS level, i, subroot AS digest FROM r
            UNION ALL
            SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM t) WHERE c > 1 GROUP BY level, i // 16),
        top AS (SELECT max_by(digest, level) AS root, max(level) AS height FROM t),
        lower_part AS (SELECT p.doc_id, p.leaf, p.i, p.source, a.level, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM p JOIN r ON r.source IS NOT DISTINCT FROM p.source
            JOIN n a ON a.source IS NOT DISTINCT FROM p.source AND a.level < r.height AND a.i = p.i // (16 ** a.level)::BIGINT
            JOIN n b ON b.source IS NOT DISTINCT FROM a.source AND b.level = a.level AND b.i // 16 = a.i // 16 GROUP BY ALL),
        upper_part AS (SELECT r.source, 100 + a.level AS level, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM r JOIN top ON true JOIN t a ON a.level < top.height AND a.i = r.i // (16 ** a.level)::BIGINT
            JOIN t b ON b.level = a.level AND b.i // 16 = a.i // 16 GROUP BY ALL),
        every AS (SELECT source, i, level, l, r FROM lower_part UNION ALL
            SELECT p.source, p.i, u.level, u.l, u.r FROM p JOIN upper_part u ON u.source IS NOT DISTINCT FROM p.source),
        proof AS (SELECT source, i, list({{'l': l, 'r': r}} ORDER BY level) AS steps FROM every GROUP BY source, i),
        told AS (SELECT p.doc_id, p.leaf, r.subroot, top.root, sha256(coalesce(list_reduce(list_transform(steps, lambda x: x.l || x.r), lambda x, y: x || y), '')) AS proof_sha256,
                coalesce(list_reduce(list_prepend({{'l': coalesce(changed, leaf), 'r': ''}}, steps), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l,
                    coalesce(changed, leaf)) AS folded_root
            FROM p JOIN r ON r.source IS NOT DISTINCT FROM p.source JOIN top ON true LEFT JOIN proof q ON q.source IS NOT DISTINCT FROM p.source AND q.i = p.i)
        SELECT *, folded_root = root AS verified FROM told""",
}
