"""The queries of this subpackage, over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bpe_codec, collocations, exact_dedup, langid, license_scan, lm_scoring, merkle, ngram_join, packing, sharding, topk, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_topk", """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


@query("op2_langid")
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op3_warc", r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
  SELECT payload_digest, max(page_id) AS best FROM p GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
FROM p JOIN best USING (payload_digest)
""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w
), occ AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM occ a JOIN occ b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.other
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
""")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query("op5_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.round_trip_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


URL_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(url, '') AS u, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_concat([0, 0], list_transform(list_filter(string_split(translate(u, '{upper}', '{lower}'), ''), lambda c: c <> ''), lambda c: instr('{signs}', c))) AS s
  FROM h
), codes AS (
  SELECT page_id, rule IN ('org/', 'com/fr/') AS acc, rule IS NOT NULL AS decided, right(sha1(url), 1) IN ('0', '1', '2') AS held,
    unnest(list_transform(range(3, len(s) + 1), lambda i: (s[i - 2] * 64 + s[i - 1]) * 64 + s[i])) AS code
  FROM ruled
), counts AS (
  SELECT code, CAST(count(*) FILTER (acc) AS DOUBLE) AS a3, CAST(count(*) FILTER (NOT acc) AS DOUBLE) AS r3 FROM codes WHERE decided AND NOT held GROUP BY code
), grid AS (
  SELECT g.code, coalesce(a3, 0) AS a3, coalesce(r3, 0) AS r3, g.code & 4095 AS c2, g.code & 63 AS c1, g.code >> 6 AS x2 FROM range(262144) g(code) LEFT JOIN counts ON counts.code = g.code
), pairs AS (
  SELECT c2, c2 & 63 AS c1, c2 >> 6 AS x1, sum(a3) AS a2, sum(r3) AS r2 FROM grid GROUP BY c2
), singles AS (SELECT c1, sum(a3) AS a1, sum(r3) AS r1 FROM grid GROUP BY c1),
heads AS (SELECT x1, sum(a2) AS ha1, sum(r2) AS hr1 FROM pairs GROUP BY x1),
ends AS (SELECT x2, sum(a3) AS ha2, sum(r3) AS hr2 FROM grid GROUP BY x2),
one AS (
  SELECT c1, (a1 + 4e0 * (1e0 / 64)) / (sum(a1) OVER () + 4e0) AS pa1, (r1 + 4e0 * (1e0 / 64)) / (sum(r1) OVER () + 4e0) AS pr1 FROM singles
), two AS (
  SELECT c2, (a2 + 4e0 * pa1) / (ha1 + 4e0) AS pa2, (r2 + 4e0 * pr1) / (hr1 + 4e0) AS pr2 FROM pairs JOIN one USING (c1) JOIN heads USING (x1)
), three AS (
  SELECT code, ln((a3 + 4e0 * pa2) / (ha2 + 4e0)) - ln((r3 + 4e0 * pr2) / (hr2 + 4e0)) AS v FROM grid JOIN two USING (c2) JOIN ends USING (x2)
), scored AS (
  SELECT page_id, sum(v) / count(*) AS score FROM codes JOIN three USING (code) GROUP BY page_id
), rows_ AS (
  SELECT ruled.page_id, url, host, path, rule, coalesce(score, 0e0) AS score FROM ruled LEFT JOIN scored ON scored.page_id = ruled.page_id
), tests AS (
  SELECT rule IN ('org/', 'com/fr/') AS acc, CAST(least(greatest(floor((score + 4e0) * 50), 0), 399) AS INT) AS bin FROM rows_ WHERE rule IS NOT NULL AND right(sha1(url), 1) IN ('0', '1', '2')
), bins AS (
  SELECT b.bin, count(*) FILTER (acc) AS a, count(*) FILTER (NOT acc) AS r FROM range(400) b(bin) LEFT JOIN tests ON tests.bin = b.bin GROUP BY b.bin
), sums AS (
  SELECT bin, bin / 50e0 - 4 AS edge, sum(a) OVER () AS ta, sum(r) OVER () AS tr, sum(a) OVER w - a AS before_a, sum(r) OVER w - r AS before_r FROM bins WINDOW w AS (ORDER BY bin)
), bar AS (
  SELECT edge AS bar FROM sums ORDER BY round((ta - before_a) / greatest(ta, 1e0) + before_r / greatest(tr, 1e0), 11) DESC, abs(edge), bin LIMIT 1
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN score >= (SELECT bar FROM bar) THEN 'allow' ELSE 'block' END AS verdict,
  round(score, 9) AS score
FROM rows_
""".replace("{upper}", url_filter.UPPER).replace("{lower}", url_filter.LOWER).replace("{signs}", url_filter.ALPHABET.replace("'", "''"))


@query("op9_url_filter", URL_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good; background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


#: DuckDB has no crc32: a fold over the bytes of the decimal id, eight shifts a byte.
MERKLE_SQL = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, text,
    {id} || {source} || {lang} || {n} AS head,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(list_filter(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: c <> ''),
      lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS crc
  FROM documents
), digests AS (
  SELECT doc_id, g, sha256(head || {text}) AS leaf, CASE WHEN doc_id IS NOT NULL AND crc % 2 = 0 THEN sha256(head || {other}) END AS changed
  FROM (SELECT *, replace(text, chr(10), '') AS bare FROM given)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
    row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS r FROM digests
), tree AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 3, n
), tops AS (
  SELECT '' AS g, 0 AS lvl, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d, g AS of FROM tree WHERE n = 1
), crown AS (
  SELECT g, lvl, pos, n, d FROM tops
  UNION ALL
  SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY g, lvl, pos // 3, n
), beside AS (
  SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM tree a JOIN tree b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.pos
), beside_top AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM crown a JOIN crown b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos
), walk AS (
  SELECT r, g, pos, 0 AS lvl, coalesce(changed, leaf) AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT r, w.g, w.pos // 3, w.lvl + 1, sha256(before || acc || after), proof || before || after
  FROM walk w JOIN beside b ON b.g = w.g AND b.lvl = w.lvl AND b.pos = w.pos
), arrived AS (
  SELECT r, g, acc, proof FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY lvl DESC) = 1
), climb AS (
  SELECT r, t.pos, 0 AS lvl, acc, proof FROM arrived a JOIN tops t ON t.of = a.g
  UNION ALL
  SELECT r, c.pos // 3, c.lvl + 1, sha256(before || acc || after), proof || before || after
  FROM climb c JOIN beside_top b ON b.lvl = c.lvl AND b.pos = c.pos
), ends AS (
  SELECT r, acc, proof FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY lvl DESC) = 1
), root AS (SELECT d AS root FROM crown WHERE n = 1)
SELECT doc_id, leaf, t.d AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM placed p JOIN ends USING (r) JOIN tops t ON t.of = p.g CROSS JOIN root
"""
for _name, _column in {"id": "doc_id", "source": "source", "lang": "lang", "n": "n_chars", "text": "text", "other": "bare"}.items():
    _value = f"CAST({_column} AS VARCHAR)"
    MERKLE_SQL = MERKLE_SQL.replace("{" + _name + "}", f"coalesce(CAST(strlen({_value}) AS VARCHAR) || ':' || {_value}, '-')")


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


@query("op12_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
places AS (
  SELECT lang, k.k AS k, unnest(list_transform(range(1, len(ws) - k.k + 2), lambda i: array_to_string(ws[i : i + k.k - 1], ' '))) AS phrase
  FROM w, range(1, 6) k(k) WHERE len(ws) >= k.k
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM places GROUP BY lang, k, phrase),
cand AS (SELECT * FROM counts WHERE k >= 2 AND f >= 100),
kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= 100 * c.f)
), cuts AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM kept
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN total ON total.lang = cuts.lang
    JOIN counts l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1 : cut], ' ')
    JOIN counts r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[cut + 1 :], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _wording(regions: list) -> str:
    """A template as a pattern over words that each stand between two blanks of their own."""
    out = ""
    for region in regions:
        if isinstance(region, bytes):
            out += f" {region.decode()} "
        elif region[0] == "optional":
            out += f"(?:{_wording(region[1])})?"
        else:
            out += f"(?: (?:{region[3] or '[^ ]+'}) ){{{region[1]},{region[2]}}}"
    return out


LICENSE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), line AS (
  SELECT doc_id, len(ws) AS n_words, array_to_string(list_transform(ws, lambda x: ' ' || x || ' '), '') AS line,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS mit,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS apache,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS gpl
  FROM w
), found AS (
  SELECT *, list_concat(mit, apache, gpl) AS places,
    list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base,
    [{matches}] AS matches
  FROM line
), spans AS (
  SELECT *, list_max(list_concat([0, CASE WHEN len(gpl) > 0 THEN 3 WHEN len(places) > 0 THEN 2 ELSE 0 END],
    list_transform(flatten(list_transform(matches, lambda m: m.spans)), lambda s: len(string_split(trim(s), '  '))))) AS w FROM found
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_concat(base, list_transform(list_filter(matches, lambda m: len(m.spans) > 0), lambda m: m.label))), ',') AS labels,
  CAST(w AS DOUBLE) / (w + 4) AS score
FROM spans
""".replace("{matches}", ", ".join(
    f"{{'label': '{label}', 'spans': regexp_extract_all(line, '{_wording(license_scan.parse(markup))}')}}" for label, markup in license_scan.TEMPLATES.items()
))


@query("op13_license_scan", LICENSE_SQL)
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(table(spark, sf_dir, "documents"))
