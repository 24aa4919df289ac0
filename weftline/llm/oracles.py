"""SQL counterparts of the corpus queries, where SQL can express them."""

from __future__ import annotations

from weftline.llm import decontaminate

ORACLE_SQL = {}


ORACLE_SQL["op3_byte_prefix_shards"] = """
WITH RECURSIVE steps AS (
    SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS k FROM range(0, 256) r(n)
    UNION ALL
    SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY n) AS v FROM steps WHERE k = 8
), bytes AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
    SELECT doc_id, n + 16 AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM bytes, crc
), placed AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
), cut AS (
    SELECT *, least(((2 * before + size) * 40 // (2 * total))::INTEGER, 39) AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


def _masked(word: str, mask: str) -> str:
    return " || ' ' || ".join(f"{word}[pos + {i}]" for i, bit in enumerate(mask) if bit == "1")


def _decontamination() -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '')"
    joins = " UNION ".join(
        f"""SELECT d.doc_id, b.item_id, d.pos - b.pos AS diagonal
        FROM (SELECT doc_id, pos, {_masked('w', m)} AS k FROM doc_at WHERE pos + {len(m) - 1} <= n) d
        JOIN (SELECT item_id, pos, {_masked('w', m)} AS k FROM item_at WHERE pos + {len(m) - 1} <= n) b USING (k)"""
        for m in decontaminate.MASKS
    )
    return f"""
WITH doc AS (SELECT doc_id, {words} AS w FROM documents), item AS (SELECT item_id, {words} AS w FROM benchmark),
doc_at AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS pos FROM doc),
item_at AS (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS pos FROM item),
hit AS ({joins}),
beside AS (
    SELECT h.doc_id, h.item_id, h.diagonal, i AS pos, len(item.w) AS n, CASE WHEN doc.w[i + h.diagonal] = item.w[i] THEN 1 ELSE -{decontaminate.PENALTY} END AS v
    FROM hit h JOIN doc USING (doc_id) JOIN item USING (item_id), unnest(range(1, len(item.w) + 1)) u(i)
    WHERE i + h.diagonal BETWEEN 1 AND len(doc.w)
), summed AS (
    SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos) AS s FROM beside
), best AS (
    SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM summed
)
SELECT doc_id, item_id, max(score)::INTEGER AS words, true AS contaminated FROM best GROUP BY doc_id, item_id HAVING max(score) >= {decontaminate.LEAST}
"""


ORACLE_SQL["op5_spaced_seed_decontamination"] = _decontamination()


def _shared(level: str, source: str, parent: str, path: str) -> str:
    """One level of the budget tree: {level}(path..., budget) from {source}(path..., weight, capacity, given)."""
    over = f"PARTITION BY {parent} ORDER BY capacity / weight, {path}"
    return f"""
{level}_a AS (SELECT *, given - coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER ({over}) AS pos FROM {source}),
{level}_b AS (SELECT *, min(CASE WHEN capacity * weights > remaining * weight THEN pos END) OVER (PARTITION BY {parent}) AS first FROM {level}_a),
{level} AS (SELECT *, CASE WHEN first IS NULL OR pos < first THEN capacity
    ELSE max(CASE WHEN pos = first THEN remaining END) OVER (PARTITION BY {parent}) * weight // max(CASE WHEN pos = first THEN weights END) OVER (PARTITION BY {parent}) END AS budget FROM {level}_b)"""


ORACLE_SQL["op9_hierarchical_mixing"] = rf"""
WITH rows AS (
    SELECT doc_id, substr(source, 1, 4) AS domain, lang, source, md5(coalesce(text, '')) AS digest,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS tokens FROM documents
), leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS n, sum(tokens)::BIGINT * 4 AS capacity FROM rows GROUP BY ALL),
one AS (SELECT domain, sum(capacity)::BIGINT AS capacity, 1::BIGINT AS weight, (SELECT sum(n)::BIGINT FROM leaf) AS given, 0 AS root FROM leaf GROUP BY domain),
{_shared("domains", "one", "root", "domain")},
two AS (SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, (CASE l.lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END)::BIGINT AS weight, any_value(d.budget)::BIGINT AS given
    FROM leaf l JOIN domains d USING (domain) GROUP BY l.domain, l.lang),
{_shared("langs", "two", "domain", "domain, lang")},
three AS (SELECT l.domain, l.lang, l.source, l.n, l.capacity, 1::BIGINT AS weight, g.budget::BIGINT AS given FROM leaf l JOIN langs g USING (domain, lang)),
{_shared("sources", "three", "domain, lang", "domain, lang, source")},
planned AS (SELECT domain, lang, source, CASE WHEN n = 0 THEN 1 ELSE budget // n END AS whole, CASE WHEN n = 0 THEN 0 ELSE budget % n END AS rest FROM sources),
marked AS (SELECT r.*, p.whole, p.rest, md5('9:' || p.whole::INTEGER || ':' || doc_id || ':' || digest) AS h FROM rows r JOIN planned p USING (domain, lang, source)),
ran AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS run FROM marked)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, (whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END)::INTEGER AS taken FROM ran
"""

ORACLE_SQL["op2_warc_archives"] = """
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), headed AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN head <> page_id THEN head END AS refers_to FROM headed
"""

ORACLE_SQL["op4_cross_polytope_duplicates"] = """
WITH RECURSIVE unit AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), least AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least
"""

_CRC_TABLE = """steps AS (
    SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS k FROM range(0, 256) r(n)
    UNION ALL
    SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY n) AS v FROM steps WHERE k = 8)"""

ORACLE_SQL["op11_burst_trie"] = f"""
WITH RECURSIVE {_CRC_TABLE},
turn AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS ts FROM turn GROUP BY conv_id
), opened AS (
    SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]))) % 6 AS h FROM own, crc
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts FROM opened o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), node AS (
    SELECT ts[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * coalesce(length(any_value(ts[d].text)), 0) AS saved
    FROM rebuilt, unnest(range(0, len(ts) + 1)) u(d) GROUP BY 1, 2
), finish AS (
    SELECT ts AS p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM rebuilt GROUP BY ts
), kids AS (
    SELECT p[1:d - 1] AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1
), whole AS (
    SELECT n.*, coalesce(k.kids, 0) AS kids FROM node n LEFT JOIN kids k USING (p)
), below AS (
    SELECT p[1:k] AS p, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM whole, unnest(range(0, d + 1)) u(k) GROUP BY 1
)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n::BIGINT AS n_convs, w.kids::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
    b.saved::BIGINT AS saved_tokens, coalesce(f.ends, sha256('')) AS ends_sha256
FROM whole w JOIN below b USING (p) LEFT JOIN finish f USING (p) LEFT JOIN node up ON w.d > 0 AND up.p = w.p[1:w.d - 1]
"""


ORACLE_SQL["op12_toivonen_collocations"] = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece
), placed AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), phrase AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, unnest([1, 2, 3]) u(k) WHERE i + k - 1 <= len(w)
), counted AS (
    SELECT lang, k, phrase, count(*) AS f FROM phrase GROUP BY ALL
), total AS (
    SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), wanted AS (
    SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10
), longer AS (
    SELECT lang, inside, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM wanted WHERE k = 3) GROUP BY ALL
), free AS (
    SELECT a.* FROM wanted a LEFT JOIN longer b ON a.lang = b.lang AND a.phrase = b.inside WHERE b.f IS NULL OR 100 * b.f < 50 * a.f
), cut AS (
    SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM free, unnest([1, 2]) u(c) WHERE c < k
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.c, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
    FROM cut c JOIN counted l ON l.lang = c.lang AND l.phrase = c.x JOIN counted r ON r.lang = c.lang AND r.phrase = c.y
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best QUALIFY rank <= 2000
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang)
"""


ORACLE_SQL["op13_suffix_array_dedup"] = """
WITH body AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), window_at AS (
    SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM body, unnest(range(0, greatest(n - 199, 0))) u(i)
), twice AS (
    SELECT r, i FROM window_at QUALIFY count(*) OVER (PARTITION BY m) > 1
), marked AS (
    SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM twice
), grouped AS (
    SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM marked
), span AS (
    SELECT r, g, min(i) AS a, max(i) + 200 AS z FROM grouped GROUP BY r, g
), edges AS (
    SELECT r, a, z FROM span UNION ALL SELECT r, n, n FROM body
), kept AS (
    SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) AS lo, a AS hi FROM edges
), rest AS (
    SELECT r, sha256(unhex(coalesce(string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo), ''))) AS sha FROM kept JOIN body USING (r) GROUP BY r
), gone AS (
    SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha AS kept_sha256
FROM body JOIN rest USING (r) LEFT JOIN gone USING (r)
"""
