"""One query per operator, over its whole table, with the digest columns its contract asks for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import conversations, exact, lines, mixing, near, negatives, packing, pii, quality, repeats, rules, topk, urls
from caseflow.llm.common import table
from caseflow.operators.ordered import attach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_classes(table(spark, folder, "documents"))


ORACLE["op1_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


def _pii_oracle() -> str:
    """The patterns without possessive repeats; places from the pieces between the matches, as in any engine without match offsets."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda p: ltrim(p, '0') != '' AND (length(ltrim(p, '0')) > 3 OR ltrim(p, '0')::INT > 255))) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN z(d, i) WHEN z(d, i) > 4 THEN 2 * z(d, i) - 9 ELSE 2 * z(d, i) END)) % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda r, v: (r * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"),
    }
    # Bare numbers: whole runs of digits; what stands around them is looked up in the text.
    around = "substr(x, s::INT, CASE WHEN s > 0 THEN 1 ELSE 0 END) NOT SIMILAR TO '[A-Za-z0-9+.-]' AND substr(x, (s + length(m) + 1)::INT, 1) NOT SIMILAR TO '[A-Za-z0-9]' AND substr(x, (s + length(m) + 1)::INT, 2) NOT SIMILAR TO '[.-][0-9]'"
    kinds["number"] = ("[0-9]+", f"length(m) BETWEEN 8 AND 12 AND {around}")
    parts, names = [], list(kinds)
    for k, (name, (pattern, test)) in enumerate(kinds.items()):
        kind = pii.KINDS[k]
        test = re.sub(r"z\(d, i\)", "(ascii(substr(d, length(d) - i::INT, 1)) - 48)", test)
        before = f"substr(x, greatest(s - {pii.REACH}, 0)::INT + 1, least(s, {pii.REACH})::INT)"
        points = f"{round(kind.prior * 100)} + CASE WHEN regexp_matches({before}, '{pii.context(kind)}') THEN {round(kind.support * 100)} ELSE 0 END"
        parts.append(f"""
{name}_cut AS (SELECT doc_id, n, x, regexp_extract_all(x, '{pattern}') AS ms, string_split_regex(x, '{pattern}') AS ps FROM t WHERE regexp_matches(x, '{pattern}')),
{name}_at AS (SELECT doc_id, n, x, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM {name}_cut),
{name}_span AS (SELECT doc_id, n, x, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
  (coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))::BIGINT AS s FROM {name}_at),
{name}_ok AS (SELECT * FROM (SELECT n, {k} AS k, '{name}' AS kind, s, s + length(m) AS e, {points} AS percent FROM {name}_span WHERE {test}) WHERE percent >= {round(kind.least * 100)})""")
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    counts = ", ".join(f"coalesce(sum(CASE WHEN kind = '{n}' THEN 1 ELSE 0 END), 0)::BIGINT AS n_{n}" for n in names[:4])
    return f"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS x FROM documents),{",".join(parts)},
found AS ({" UNION ALL ".join(f"SELECT * FROM {n}_ok" for n in names)})
SELECT any_value(t.doc_id) AS doc_id, {counts}, sha256(coalesce({listed} FILTER (WHERE k < 4), '')) AS base_sha256, coalesce({listed}, '') AS spans,
  coalesce(string_agg(kind || ':' || s || ':' || percent, ',' ORDER BY k, s), '') AS scores
FROM t LEFT JOIN found USING (n) GROUP BY t.n
"""


ORACLE["op3_pii"] = _pii_oracle()


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))[0]


@query
def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query
def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op10_topk"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def public_vocabulary() -> str:
    """Where the public tokenizer file lies on this machine; its package names the place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), packing.Packing(public_vocabulary()))


@query
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_classes(table(spark, folder, "documents"))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines with words, how many go, how many of these were only close, and the numbers of those that go."""
    decided = lines.line_decisions(table(spark, folder, "documents"))
    counted = decided.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("kept")).alias("n_removed"), F.count_if("near").alias("n_near"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))), ",").alias("removed"),
    )
    ids = table(spark, folder, "documents").select("doc_id").distinct()
    none = {"n_lines": 0, "n_removed": 0, "n_near": 0, "removed": ""}
    return attach(ids, counted, ["doc_id"]).fillna(none, list(none))


@query
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """A row in seven gets a wrong label first, so that labels and neighbourhoods disagree."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE["op12_hard_negatives"] = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
close AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM close WHERE rank <= 5
"""


def _damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of their rows, dealt by a checksum of conversation and turn."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", plain("conv_id"), plain("turn")), "UTF-8")) % 20
    dealt = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    copies = F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int"))).alias("copy")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return dealt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)


@query
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversations.with_conversations(turns, conversations.repaired(_damaged(turns), "copy"))


def _conversation_oracle() -> str:
    """The plain recursion over turns, last one first; costs, audit and repaired text of the four places side by side."""
    polynomial = 3988292384
    bits = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x >> 1, (x & 1) * {polynomial}))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    onward, name = {"n": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    step = lambda cost, letter, line, after: f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 't': list_prepend({line}, {after}.t)}}"
    turn, level = [], []
    for place, to in onward.items():
        fits = {"n": "i IN ('s', 'u')", "s": "i = 'u'", "u": "i = 'a'", "a": "i = 'u'"}[place]
        kept = f"CASE WHEN i = 's' THEN {step('extra', 'K', 'line', 's')} ELSE {step('extra', 'K', 'line', 'u')} END" if place == "n" else step("extra", "K", "line", to)
        options = [f"{{'c': 2 + {place}.c, 'a': 'D' || {place}.a, 't': {place}.t}}", f"CASE WHEN NOT gone AND {fits} THEN {kept} END", f"CASE WHEN NOT gone THEN {step('extra + 1', 'R', f"'{name[to]}:' || text", to)} END"]
        turn.append(f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL)) AS {place}")
        two = onward[to]
        once = step("5", "I", f"'{name[to]}:'", to)
        twice = f"{{'c': 10 + {two}.c, 'a': 'II' || {two}.a, 't': list_concat(['{name[to]}:', '{name[two]}:'], {two}.t)}}"
        level.append(f"list_min([{place}, {once}, {twice}]) AS {place}")
    none = lambda c: f"{{'c': {c}::BIGINT, 'a': '', 't': []::VARCHAR[]}}"
    end = ", ".join(f"{none(0 if p in 'na' else 10**9)} AS {p}" for p in onward)
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (
  SELECT *, substr(role, 1, 1) AS i, role || ':' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
signs AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault, lead(i) OVER (PARTITION BY conv_id ORDER BY p) AS next_i FROM placed),
turns AS (
  SELECT conv_id, p, i, text, line, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END::BIGINT AS extra FROM signs),
counts AS (
  SELECT conv_id, count(*) AS n_turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_i IS NOT NULL AND i || next_i NOT IN ('su', 'ua', 'au')) AS illegal FROM signs GROUP BY conv_id),
walk AS (
  SELECT conv_id, n_turns + 1 AS p, {", ".join(level)} FROM (SELECT conv_id, n_turns, {end} FROM counts)
  UNION ALL
  SELECT conv_id, p, {", ".join(level)} FROM (
    SELECT w.conv_id, t.p, {", ".join(turn)} FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.p = w.p - 1))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(w.n.c, 0) AS cost, coalesce(w.n.a, '') AS audit, sha256(coalesce(array_to_string(w.n.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walk w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.p = 1
"""


ORACLE["op11_conversations"] = _conversation_oracle()


@query
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.judged(rules.statistics(table(spark, folder, "documents")))
    return found.select("doc_id", *rules.BASE, "base_failed", "kept")


@query
def rule_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics the quality rules judge by, and the fixed rules on them."""
    found = rules.statistics(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", *rules.BASE, rules.base_failed().alias("base_failed"))


ORACLE["rule_statistics"] = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
s AS (
  SELECT r, doc_id, x, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) > 4)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) o(k) GROUP BY r),
counted AS (
  SELECT doc_id, len(l) AS n_lines, len(w) AS n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM s LEFT JOIN covered USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
"""
