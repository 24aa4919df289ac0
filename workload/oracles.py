"""The same answers as the catalog in plain SQL, mostly in closed form from the fixtures."""

from __future__ import annotations

NEWLINE = "chr(10)"
TRANSLATED = "translate(md5(CAST(j AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _genome(lo: str, hi: str) -> str:
    """Bases [lo, hi) of the synthetic genome."""
    tiles = f"list_transform(range(({lo}) // 32, ({hi} - 1) // 32 + 1), lambda j: {TRANSLATED})"
    return f"substring(array_to_string({tiles}, ''), CAST(({lo}) % 32 + 1 AS BIGINT), CAST(({hi}) - ({lo}) AS BIGINT))"


def _complement(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


def _norm(source: str) -> str:
    return f"""SELECT line_no, CAST(split_part(q_name, '_', 2) AS BIGINT) AS a, CAST(split_part(t_name, '_', 2) AS BIGINT) AS b,
      q_start AS a_start, q_end AS a_end, q_len AS a_len, CAST(CASE WHEN strand = '+' THEN 0 ELSE 1 END AS BIGINT) AS b_orient,
      CASE WHEN strand = '-' THEN t_len - t_end ELSE t_start END AS b_start,
      CASE WHEN strand = '-' THEN t_len - t_start ELSE t_end END AS b_end, t_len AS b_len,
      CAST(round(sqrt(n_match)) AS BIGINT) AS w FROM {source}"""


DANGLING = "greatest(least(a_start, b_start), least(a_len - a_end, b_len - b_end))"


def _usable(source: str) -> str:
    return f"SELECT * FROM ({_norm(source)}) WHERE a <> b AND {DANGLING} < 80"


_FIELDS = "q_name, q_len, q_start, q_end, strand, t_name, t_len, t_start, t_end, n_match, aln_len"
_TURNED = "t_name, t_len, t_start, t_end, strand, q_name, q_len, q_start, q_end, n_match, aln_len"
_TURN = "(31 * CAST(split_part(q_name, '_', 2) AS BIGINT) + 17 * CAST(split_part(t_name, '_', 2) AS BIGINT)) % 5 < 2"


def _mixed(source: str) -> str:
    return (
        f"SELECT line_no, {_FIELDS} FROM {source} WHERE NOT ({_TURN}) UNION ALL "
        f"SELECT line_no, {_TURNED} FROM {source} WHERE {_TURN}"
    )


def _span(side: str, left: bool) -> str:
    s, e = f"{side}.g_start", f"{side}.g_end"
    forward, backward = (f"lo - {s}", f"{e} - hi") if left else (f"hi - {s}", f"{e} - lo")
    return f"CASE WHEN {side}.strand = 1 THEN {forward} ELSE {backward} END"


CTES = {
    "sim": """SELECT *, g_start + read_len AS g_end FROM (SELECT p_partkey AS read_id, 900 * p_partkey + (104729 * p_partkey) % 400 AS g_start,
      5000 + (7919 * p_partkey) % 4000 AS read_len,
      CAST(CASE WHEN (31 * p_partkey) % 7 < 3 THEN -1 ELSE 1 END AS BIGINT) AS strand FROM part)""",
    "paf": f"""SELECT a.read_id * 16 + b.read_id - a.read_id AS line_no, 'read_' || a.read_id AS q_name, a.read_len AS q_len,
      {_span('a', True)} AS q_start, {_span('a', False)} AS q_end, CASE WHEN a.strand = b.strand THEN '+' ELSE '-' END AS strand,
      'read_' || b.read_id AS t_name, b.read_len AS t_len, {_span('b', True)} AS t_start, {_span('b', False)} AS t_end,
      (9 * (hi - lo)) // 10 AS n_match, hi - lo AS aln_len
      FROM (SELECT *, i + d AS k FROM (SELECT read_id AS i FROM sim), (SELECT unnest(range(1, 13)) AS d)) p
      JOIN sim a ON a.read_id = p.i JOIN sim b ON b.read_id = p.k,
      LATERAL (SELECT greatest(a.g_start, b.g_start) AS lo, least(a.g_end, b.g_end) AS hi) WHERE hi - lo >= 1000""",
    "noisy": """SELECT line_no, q_name, q_len, q_start + s AS q_start, q_end - s AS q_end, strand, t_name, t_len, t_start + s AS t_start,
      t_end - s AS t_end, n_match, aln_len FROM (SELECT *, CASE WHEN (7 * a + 13 * b) % 29 = 0 THEN 400 ELSE 0 END AS s FROM
      (SELECT *, CAST(split_part(q_name, '_', 2) AS BIGINT) AS a, CAST(split_part(t_name, '_', 2) AS BIGINT) AS b FROM paf)
      WHERE NOT ((a % 50 = 17 OR b % 50 = 17) AND aln_len >= 2500))""",
    "selfy": f"""SELECT line_no, {_FIELDS} FROM noisy UNION ALL SELECT read_id * 16, 'read_' || read_id, read_len, 0, read_len, '+',
      'read_' || read_id, read_len, 0, read_len, read_len, read_len FROM sim WHERE read_id % 10 = 0""",
    "dual": f"SELECT line_no * 2 AS line_no, {_FIELDS} FROM noisy UNION ALL SELECT line_no * 2 + 1, {_TURNED} FROM noisy",
    "mixed": _mixed("paf"),
    "mixedn": _mixed("noisy"),
    "nn": _norm("noisy"),
    "un": _usable("noisy"),
    "uc": _usable("paf"),
    "um": _usable("mixed"),
    "ud": _usable("dual"),
    "umn": _usable("mixedn"),
    "lens": """SELECT read_id, arg_max(len, line_no * 2 + side) AS len FROM (
      SELECT CAST(split_part(q_name, '_', 2) AS BIGINT) AS read_id, q_len AS len, line_no, 0 AS side FROM noisy UNION ALL
      SELECT CAST(split_part(t_name, '_', 2) AS BIGINT), t_len, line_no, 1 FROM noisy) GROUP BY read_id""",
    "reach": """SELECT read_id, max(CASE WHEN side = 'F' THEN value END) AS front, max(CASE WHEN side = 'R' THEN value END) AS back FROM (
      SELECT CASE WHEN side = 1 THEN CASE kind WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN a ELSE b END
                  ELSE CASE kind WHEN 1 THEN b WHEN 2 THEN a WHEN 3 THEN b ELSE a END END AS read_id,
             CASE WHEN kind = 3 THEN 'F' WHEN kind = 4 THEN 'R' WHEN side = 1 THEN 'F' ELSE 'R' END AS side,
             CASE kind WHEN 1 THEN CASE WHEN side = 1 THEN q_end ELSE t_len - t_start END
                       WHEN 2 THEN CASE WHEN side = 1 THEN t_end ELSE q_len - q_start END
                       WHEN 3 THEN CASE WHEN side = 1 THEN q_end ELSE t_end END
                       ELSE CASE WHEN side = 1 THEN t_len - t_start ELSE q_len - q_start END END AS value
      FROM (SELECT *, CAST(split_part(q_name, '_', 2) AS BIGINT) AS a, CAST(split_part(t_name, '_', 2) AS BIGINT) AS b,
              CASE WHEN strand = '+' AND t_len - t_end < 150 AND q_start < 150 THEN 1
                   WHEN strand = '+' AND q_len - q_end < 150 AND t_start < 150 THEN 2
                   WHEN strand = '-' AND t_start < 150 AND q_start < 150 THEN 3
                   WHEN strand = '-' AND q_len - q_end < 150 AND t_len - t_end < 150 THEN 4 END AS kind FROM noisy),
           (SELECT unnest([1, 2]) AS side) WHERE kind IS NOT NULL AND a <> b) GROUP BY read_id""",
    "chim": """SELECT l.read_id, l.len, coalesce(r.front, 0) + coalesce(r.back, 0) AS covered FROM lens l LEFT JOIN reach r USING (read_id)
      WHERE coalesce(r.front, 0) + coalesce(r.back, 0) < l.len + 300""",
    "chim50": f"""SELECT n.read_id FROM (SELECT unnest(range(1, (SELECT count(*) FROM sim) + 1)) AS read_id) n LEFT JOIN (
      SELECT read_id, max(CASE WHEN side = 'F' THEN value END) AS front, max(CASE WHEN side = 'R' THEN value END) AS back FROM (
        SELECT CASE WHEN pick = 1 THEN a ELSE b END AS read_id,
          CASE WHEN kind IN (1, 3) THEN CASE WHEN pick = 1 OR kind = 3 THEN 'F' ELSE 'R' END
               ELSE CASE WHEN pick = 2 AND kind = 2 THEN 'F' ELSE 'R' END END AS side,
          CASE WHEN kind IN (1, 3) THEN CASE WHEN pick = 1 THEN a_end ELSE b_len - b_start END
               ELSE CASE WHEN pick = 1 THEN a_len - a_start ELSE b_end END END AS value
        FROM (SELECT *, CASE WHEN b_len - b_end < 50 AND a_start < 50 THEN 1 + 2 * b_orient
                             WHEN a_len - a_end < 50 AND b_start < 50 THEN 2 + 2 * b_orient END AS kind FROM nn),
             (SELECT unnest([1, 2]) AS pick) WHERE kind IS NOT NULL AND a <> b) GROUP BY read_id) r USING (read_id)
      LEFT JOIN lens l USING (read_id) WHERE front IS NULL OR back IS NULL OR front + back < l.len""",
    "box": "SELECT min(g_start) AS lo, max(g_end) AS hi FROM sim",
    "bins": "SELECT read_id // 50 AS c, min(g_start) AS lo, max(g_end) AS hi, count(*) AS n FROM sim GROUP BY 1",
    "tl": """SELECT c AS contig_id, read_id, start, dir, len, n, row_number() OVER (PARTITION BY c ORDER BY start, read_id) - 1 AS rank, g_start, g_end FROM (
      SELECT bins.c, read_id, CASE WHEN bins.c % 2 = 1 THEN hi - g_end ELSE g_start - lo END AS start,
             CASE WHEN bins.c % 2 = 1 THEN -strand ELSE strand END AS dir, read_len AS len, n, g_start, g_end
      FROM sim JOIN bins ON bins.c = read_id // 50)""",
    "ends": """SELECT o.line_no, o.a, o.b, p.contig_id AS ca, q.contig_id AS cb, o.b_orient, o.w, p.dir AS da, q.dir AS db
      FROM uc o JOIN tl p ON p.read_id = o.a JOIN tl q ON q.read_id = o.b
      WHERE p.contig_id <> q.contig_id AND least(p.rank, p.n - p.rank) <= 15 AND least(q.rank, q.n - q.rank) <= 15""",
    "origin": "SELECT c, CASE WHEN c % 2 = 1 THEN hi ELSE lo END AS x FROM bins",
    "blk": """SELECT k AS block, read_id, strand, g_start, greatest(g_start, 2400 * k) AS lo, least(g_end, 2400 * k + 3000) AS hi
      FROM sim, (SELECT unnest(range(0, (SELECT hi // 2400 + 1 FROM box))) AS k)
      WHERE g_start < 2400 * k + 3000 AND g_end > 2400 * k AND least(g_end, 2400 * k + 3000) - greatest(g_start, 2400 * k) > 1""",
    "cns": "SELECT block, 2400 * block AS lo, max(hi) AS hi FROM blk GROUP BY block",
    "parent_link": "SELECT a AS u, b AS v, w FROM uc QUALIFY row_number() OVER (PARTITION BY b ORDER BY w DESC, a) = 1",
    "walked": """SELECT DISTINCT u AS node, u AS root, CAST([] AS BIGINT[]) AS path FROM parent_link WHERE u NOT IN (SELECT v FROM parent_link) UNION ALL
      SELECT l.v, root, list_append(path, l.w * 10000000000 - l.v) FROM walked JOIN parent_link l ON l.u = walked.node""",
    "walk": "SELECT node AS read_id, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS visit FROM walked",
    "steps": """SELECT o.line_no, o.a, o.b, o.w, (CASE WHEN s.strand = 1 THEN s.g_start ELSE s.g_end END) AS xa,
      (CASE WHEN t.strand = 1 THEN t.g_start ELSE t.g_end END) AS xb, s.g_start AS sa, t.g_start AS sb
      FROM un o JOIN sim s ON s.read_id = o.a JOIN sim t ON t.read_id = o.b""",
}


def _seed(source: str) -> str:
    """Read that enters the graph last."""
    return f"""(SELECT arg_max(node, seen) FROM (SELECT node, min(seen) AS seen FROM (SELECT a AS node, line_no * 2 AS seen FROM {source}
      UNION ALL SELECT b, line_no * 2 + 1 FROM {source}) GROUP BY node))"""


def _facing(source: str) -> str:
    """Reads in the direction of the seed: start, dir and len."""
    return f"""SELECT s.read_id, CASE WHEN z.strand = 1 THEN s.g_start - box.lo ELSE box.hi - s.g_end END AS start,
      s.strand * z.strand AS dir, s.read_len AS len FROM sim s, box, sim z WHERE z.read_id = {_seed(source)}"""


def _quantile(p: float) -> str:
    return f"""SELECT CAST({round(p * 100)} AS BIGINT) AS percent, CAST(round(quantile_cont(r, {p}) * 1000) AS BIGINT) AS milli,
      CAST(round(avg(CASE WHEN r <= 200 THEN 1.0::DOUBLE ELSE 200 / r END) * 1000) AS BIGINT) AS mean_weight
      FROM (SELECT CASE WHEN (17 * a + 5 * b) % 97 = 0 THEN 1500.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM uc)"""


_VOTES = """count(*) AS n, CAST((sum(abs(sw)) + sum(sw)) // 2 AS BIGINT) AS pos, CAST((sum(abs(sw)) - sum(sw)) // 2 AS BIGINT) AS neg,
  CAST(greatest((sum(abs(sw)) + sum(sw)) // 2, (sum(abs(sw)) - sum(sw)) // 2) AS BIGINT) AS strength, CAST(sign(sum(sw)) AS BIGINT) AS sgn"""
_SW = "CASE WHEN b_orient = 0 THEN w ELSE -w END"
_EXPORT = "1048"


def _reads(source: str) -> str:
    return f"SELECT *, CASE WHEN strand = 1 THEN g ELSE {_complement('g')} END AS seq FROM (SELECT *, {_genome('g_start', 'g_end')} AS g FROM {source})"


BODIES = {
    "paf_parse": f"""SELECT line_no, {_FIELDS}, CAST(split_part(q_name, '_', 2) AS BIGINT) AS a, CAST(split_part(t_name, '_', 2) AS BIGINT) AS b,
      CAST(CASE WHEN strand = '+' THEN 0 ELSE 1 END AS BIGINT) AS b_orient FROM noisy""",
    "blasr_parse": """SELECT nn.line_no, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(0 AS BIGINT) AS a_orient, b_orient, -n_match AS score,
      a_start, a_end, a_len, b_start, b_end, b_len FROM nn JOIN noisy USING (line_no)""",
    "mhap_parse": """SELECT line_no, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(0 AS BIGINT) AS a_orient, a_start, a_end, a_len,
      b_orient, b_start, b_end, b_len FROM nn""",
    "fasta_parse": f"SELECT read_id, length(seq) AS bases, md5(seq) AS digest FROM ({_reads('sim')})",
    "overlap_normalise": "SELECT * FROM nn",
    "overlap_weight": f"SELECT line_no, a, b, {_SW} AS sw FROM nn",
    "self_overlap_filter": f"SELECT line_no, a, b, w FROM ({_norm('selfy')}) WHERE a <> b",
    "dangling_lengths": f"SELECT line_no, {DANGLING} AS dangling FROM nn",
    "dangling_filter": "SELECT line_no, a, b, w FROM un",
    "overlap_counts": f"""SELECT unnest(['records', 'self', 'dangling', 'usable']) AS metric, CAST(unnest([count(*), count(*) FILTER (a = b),
      count(*) FILTER (a <> b AND {DANGLING} >= 80), count(*) FILTER (a <> b AND {DANGLING} < 80)]) AS BIGINT) AS value FROM ({_norm('selfy')})""",
    "inconsistent_overlaps": """SELECT o.line_no, o.a, o.b FROM un o JOIN sim s ON s.read_id = o.a JOIN sim t ON t.read_id = o.b
      WHERE (b_orient = 0) <> (CASE WHEN a % 11 = 0 THEN -s.strand ELSE s.strand END = CASE WHEN b % 11 = 0 THEN -t.strand ELSE t.strand END)""",
    "reach_by_end": "SELECT read_id, coalesce(front, 0) AS front, coalesce(back, 0) AS back FROM reach",
    "chimera_candidates": "SELECT * FROM chim",
    "chimera_filtered_overlaps": "SELECT line_no, a, b, w FROM un WHERE a NOT IN (SELECT read_id FROM chim) AND b NOT IN (SELECT read_id FROM chim)",
    "low_quality_counts": """SELECT read_id, count(*) AS n_low FROM (SELECT CAST(unnest([split_part(q_name, '_', 2), split_part(t_name, '_', 2)]) AS BIGINT) AS read_id
      FROM selfy WHERE n_match < 2000 OR n_match / aln_len < 0.6) GROUP BY read_id""",
    "blasr_chimera": "SELECT read_id FROM chim50",
    "mhap_chimera": "SELECT read_id FROM chim50",
    "read_lengths": """SELECT read_id, read_len AS len FROM sim WHERE read_id % 10 = 0 OR read_id IN (SELECT read_id FROM lens)""",
    "overlaps_per_pair": "SELECT a, b, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM ud GROUP BY a, b",
    "edge_weight_last": f"""SELECT least(a, b) AS u, greatest(a, b) AS v, arg_max({_SW}, line_no) AS sw, min(line_no) AS first_line FROM ud GROUP BY 1, 2""",
    "edge_links_first": f"""SELECT least(a, b) AS u, greatest(a, b) AS v, arg_min({_SW}, line_no) AS sw, coalesce(min(CASE WHEN a < b THEN line_no END), -1) AS uv_line,
      coalesce(min(CASE WHEN a > b THEN line_no END), -1) AS vu_line, count(*) AS n FROM umn GROUP BY 1, 2""",
    "orientation_votes": f"SELECT u, v, {_VOTES} FROM (SELECT least(a, b) AS u, greatest(a, b) AS v, {_SW} AS sw FROM ud) GROUP BY u, v",
    "vote_probability": f"""SELECT u, v, CAST(round(1000000 / (1 + exp(-CAST(sum(sw) AS DOUBLE) / 100))) AS BIGINT) AS p
      FROM (SELECT a AS u, b AS v, {_SW} AS sw FROM un) GROUP BY u, v""",
    "read_offset": "SELECT line_no, a, b, xb - xa AS step FROM steps",
    "start_offset": "SELECT line_no, a, b, sb - sa AS step FROM steps",
    "equations_plain": "SELECT a AS i, b AS j, xb - xa AS y, CAST(1000000 AS BIGINT) AS scale FROM steps",
    "equations_weighted": "SELECT a AS i, b AS j, xb - xa AS y, CAST(round(sqrt(w) * 1000000) AS BIGINT) AS scale FROM steps",
    "equations_indel": """SELECT a AS i, b AS j, CAST(trunc((xb - xa) * (CAST(1 AS DOUBLE) - CAST(0.006875 AS DOUBLE))) AS BIGINT) AS y,
      CAST(1000000 AS BIGINT) AS scale FROM steps""",
    "equations_visit_order": """SELECT a AS u, b AS v, abs((CASE WHEN t.strand = 1 THEN t.g_start ELSE t.g_end END)
      - (CASE WHEN s.strand = 1 THEN s.g_start ELSE s.g_end END)) AS gap FROM uc o JOIN sim s ON s.read_id = o.a JOIN sim t ON t.read_id = o.b""",
    "spanning_orientation_rooted": "SELECT s.read_id, s.strand * z.strand AS dir FROM sim s, sim z WHERE z.read_id = 7",
    "components": """SELECT read_id, first_value(read_id) OVER (PARTITION BY run ORDER BY read_id) AS component FROM (
      SELECT read_id, sum(fresh) OVER (ORDER BY g_start, read_id) AS run FROM (
        SELECT read_id, g_start, CASE WHEN max(g_end) OVER (ORDER BY g_start, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= g_start + 1000 THEN 0 ELSE 1 END AS fresh
        FROM sim WHERE read_id IN (SELECT a FROM uc UNION SELECT b FROM uc)))""",
    "components_binned": """SELECT read_id, (read_id // 37) * 37 AS component FROM sim
      WHERE (read_id // 37) * 37 + 1 < (SELECT count(*) FROM sim)""",
    "spanning_orientation": """SELECT s.read_id, z.read_id AS component, s.strand * z.strand AS dir FROM sim s, sim z
      WHERE z.read_id = (SELECT min(a) FROM un)""",
    "greedy_orientation": f"""SELECT z.read_id AS component, s.read_id, s.strand * z.strand AS dir FROM sim s, sim z WHERE z.read_id = {_seed('un')}""",
    "orientation_conflicts": f"""SELECT z.read_id AS component, s.read_id, s.strand * z.strand AS dir FROM sim s, sim z WHERE z.read_id = {_seed('un')}""",
    # one half turned: the lighter side's links stand against the read
    "suspicious_reads": """SELECT read_id, CAST(least(l, r) AS BIGINT) AS against, CAST(l + r AS BIGINT) AS weight FROM (
      SELECT s.read_id, sum(CASE WHEN t.read_id < s.read_id THEN 20 - d ELSE 0 END) AS l, sum(CASE WHEN t.read_id > s.read_id THEN 20 - d ELSE 0 END) AS r
      FROM sim s JOIN sim t ON t.read_id <> s.read_id AND abs(t.read_id - s.read_id) <= 12, LATERAL (SELECT abs(t.read_id - s.read_id) AS d)
      WHERE s.read_id % 40 = 20 GROUP BY s.read_id) WHERE 4 * least(l, r) >= l + r""",
    "tree_walk_order": "SELECT read_id, visit FROM walk",
    "equations_walk_order": """SELECT o.a AS i, o.b AS j, (CASE WHEN t.strand = 1 THEN t.g_start ELSE t.g_end END)
      - (CASE WHEN s.strand = 1 THEN s.g_start ELSE s.g_end END) AS y FROM um o JOIN sim s ON s.read_id = o.a JOIN sim t ON t.read_id = o.b
      JOIN walk p ON p.read_id = o.a JOIN walk q ON q.read_id = o.b WHERE p.visit < q.visit""",
    "layout_positions": _facing("uc"),
    "layout_positions_mixed": _facing("um"),
    "layout_positions_noisy": _facing("un"),
    "robust_positions": """SELECT read_id, p - first_value(p) OVER (ORDER BY read_id) AS x
      FROM (SELECT read_id, CASE WHEN strand = 1 THEN g_start ELSE g_end END AS p FROM sim)""",
    "residual_percentiles": " UNION ALL ".join(_quantile(p) for p in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)),
    "layout_split": "SELECT read_id, (SELECT arg_min(read_id, g_start) FROM sim) AS contig_id, g_start AS start FROM sim",
    "layout_index": "SELECT contig_id, read_id, start, rank, n - rank AS from_back FROM tl",
    "layout_spans": "SELECT contig_id, count(*) AS n_reads, max(start + len) - min(start) AS span FROM tl GROUP BY contig_id",
    "contig_end_overlaps": "SELECT line_no, a, b, ca, cb FROM ends",
    "contig_votes": f"""SELECT u, v, {_VOTES} FROM (SELECT least(ca, cb) AS u, greatest(ca, cb) AS v, ({_SW}) * da * db AS sw FROM ends) GROUP BY u, v""",
    "contig_orientation": "SELECT c AS contig_id, CAST(0 AS BIGINT) AS component, CAST(CASE WHEN c % 2 = 1 THEN -1 ELSE 1 END AS BIGINT) AS dir FROM bins",
    "contig_offset_median": """SELECT e.ca AS i, e.cb AS j, any_value(q.x - p.x) AS y, count(*) AS n_links FROM ends e
      JOIN origin p ON p.c = e.ca JOIN origin q ON q.c = e.cb GROUP BY e.ca, e.cb HAVING count(*) >= 3""",
    "contig_positions": "SELECT c AS contig_id, CAST(0 AS BIGINT) AS layout, x - (SELECT x FROM origin WHERE c = 0) AS x FROM origin",
    "contig_merge": "SELECT CAST(0 AS BIGINT) AS layout, read_id, g_start - lo AS start, strand AS dir FROM sim, box",
    "contig_offsets_plain": """SELECT o.line_no, p.c AS i, q.c AS j, q.lo - p.lo AS y FROM uc o JOIN bins p ON p.c = o.a // 50
      JOIN bins q ON q.c = o.b // 50 WHERE p.c <> q.c""",
    "contig_offsets_plain_median": """SELECT p.c AS i, q.c AS j, any_value(q.lo - p.lo) AS y, count(*) AS n_links FROM uc o JOIN bins p ON p.c = o.a // 50
      JOIN bins q ON q.c = o.b // 50 WHERE p.c <> q.c GROUP BY p.c, q.c""",
    "contig_round": """SELECT first_value(read_id) OVER w AS contig_id, read_id, g_start - lo AS start, strand AS dir, row_number() OVER w - 1 AS rank
      FROM sim, box WINDOW w AS (ORDER BY g_start, read_id)""",
    "layout_contigs": f"""SELECT first_value(read_id) OVER w AS contig_id, read_id, start, dir, row_number() OVER w - 1 AS rank
      FROM ({_facing('uc')}) WINDOW w AS (ORDER BY start, read_id)""",
    "component_assembly": f"""SELECT first_value(read_id) OVER (ORDER BY start, read_id) AS layout, read_id, start, dir FROM ({_facing('uc')})""",
    "contig_iteration": "SELECT first_value(read_id) OVER (ORDER BY g_start, read_id) AS layout, read_id, g_start - lo AS start, strand AS dir FROM sim, box",
    "reverse_complements": f"SELECT read_id, md5({_complement('seq')}) AS digest FROM ({_reads('sim')})",
    "wrapped_sequences": f"""SELECT read_id, md5(t) AS digest, length(t) AS size FROM (SELECT read_id, array_to_string(list_transform(
      range(0, (length(seq) + 99) // 100), lambda i: substring(seq, i * 100 + 1, 100)), {NEWLINE}) AS t FROM ({_reads('sim')}))""",
    "gc_content": f"SELECT read_id, length(regexp_replace(seq, '[AT]', '', 'g')) AS gc FROM ({_reads('sim')})",
    "block_coverage": "SELECT block, count(*) AS n_slices, CAST(sum(hi - lo) AS BIGINT) AS bases FROM blk GROUP BY block",
    "block_slices": f"""SELECT block, read_id, lo - g_start AS "offset", hi - lo AS bases, md5({_genome('lo', 'hi')}) AS digest FROM blk""",
    "block_consensus": f"SELECT block, hi - lo AS bases, md5({_genome('lo', 'hi')}) AS digest FROM cns",
    "block_consensus_noisy": f"""SELECT block, length(cns) AS bases, md5(cns) AS digest FROM (SELECT block, array_to_string(list_transform(
      range(75 * block, least(75 * block + 94, tiles)), lambda j: CASE WHEN j % 10 = 7 THEN repeat('AC', 8) || substr({TRANSLATED}, 1, 16) ELSE {TRANSLATED} END), '') AS cns
      FROM (SELECT max(g_end) // 32 AS tiles FROM sim) t, LATERAL (SELECT unnest(range(0, (tiles - 1) // 75 + 1)) AS block) b)""",
    "block_joins": """SELECT block, CAST(600 AS BIGINT) AS tail, least(600, hi - lo) AS score, CAST(600 AS BIGINT) AS left_end, least(600, hi - lo) AS right_end
      FROM cns WHERE block > 0""",
    "stitched_pieces": f"""SELECT CAST(1 AS BIGINT) AS contig_no, block, lo AS "offset", hi - lo AS bases, md5({_genome('lo', 'hi')}) AS digest FROM (
      SELECT block, least(cns.lo, box.hi - 600) AS lo, CASE WHEN lead(cns.lo) OVER (ORDER BY block) IS NULL THEN box.hi ELSE least(lead(cns.lo) OVER (ORDER BY block), box.hi - 600) END AS hi FROM cns, box)""",
    "contig_fasta": f"""SELECT CAST(1 AS BIGINT) AS contig_no, CAST(-1 AS BIGINT) AS line_no, '>contig1' AS text UNION ALL
      SELECT CAST(1 AS BIGINT), i, {_genome('i * 100', 'least(i * 100 + 100, hi)')} FROM box, (SELECT unnest(range(0, (SELECT (hi + 99) // 100 FROM box))) AS i)""",
    "layout_export": f"""WITH size AS (SELECT contig_id, max(start + len) AS length, (max(start + len) + {_EXPORT} - 1) // {_EXPORT} AS edges FROM tl GROUP BY contig_id),
      num AS (SELECT *, CAST(sum(edges) OVER (ORDER BY contig_id) - edges AS BIGINT) AS node FROM size),
      cut AS (SELECT *, greatest(start, {_EXPORT} * k) - start AS o, least(start + len, {_EXPORT} * k + 2048) - greatest(start, {_EXPORT} * k) AS m
        FROM (SELECT tl.*, unnest(range(0, edges)) AS k FROM tl JOIN size USING (contig_id)))
      SELECT contig_id, CAST(-1 AS BIGINT) AS block, CAST(-1 AS BIGINT) AS rank, md5('>ctg' || contig_id || chr(9) || 'nodes=' || (length // {_EXPORT} + 1) || chr(9) || 'len=' || length) AS digest FROM num
      UNION ALL SELECT contig_id, k, CAST(-1 AS BIGINT), md5('E' || chr(9) || (k * {_EXPORT}) || chr(9) || 'N' || (node + k) || chr(9) || '+' || chr(9) || 'N' || (node + k + 1) || chr(9) || '+')
        FROM (SELECT *, unnest(range(0, edges)) AS k FROM num)
      UNION ALL SELECT contig_id, k, rank, md5('S' || chr(9) || 'read.' || read_id || chr(9) || CASE WHEN dir = 1 THEN '+' ELSE '-' END || chr(9) || o || chr(9) || m || chr(9) ||
        CASE WHEN contig_id % 2 = 1 THEN {_complement(_genome('g_end - o - m', 'g_end - o'))} ELSE {_genome('g_start + o', 'g_start + o + m')} END)
        FROM cut WHERE start < {_EXPORT} * k + 2048 AND start + len > {_EXPORT} * k AND m > 1""",
    "run_report": """SELECT unnest(['records', 'self', 'dangling', 'usable', 'oriented', 'oriented_reads', 'inconsistent', 'reads_equations', 'reads_placed']) AS metric,
      unnest([records, own, records - own - used, used, used, reads, 0, used, reads]) AS value FROM (SELECT count(*) AS records, count(*) FILTER (q_name = t_name) AS own FROM selfy),
        (SELECT count(*) AS used FROM un), (SELECT count(*) AS reads FROM (SELECT a FROM un UNION SELECT b FROM un)) UNION ALL
      SELECT unnest(['reads_rounds', 'reads_reweighted', 'reads_dropped', 'reads_residual_max', 'reads_residual_p50', 'reads_residual_p90', 'reads_residual_p99', 'unaligned_slices']),
        unnest([1, 0, 0, 0, 0, 0, 0, 0]) UNION ALL  -- the read level runs one round whatever the residuals
      SELECT unnest(['blocks', 'consensus_bases']), unnest([count(*), CAST(sum(hi - lo) AS BIGINT)]) FROM cns""",
    "assembly_stats": """SELECT count(*) AS n_contigs, CAST(max(total) AS BIGINT) AS total_length, max(length) AS largest,
      max(CASE WHEN upto * 2 >= total THEN length END) AS n50, min(CASE WHEN upto * 2 >= total THEN place END) AS l50,
      max(CASE WHEN upto * 10 >= total * 9 THEN length END) AS n90, min(CASE WHEN upto * 10 >= total * 9 THEN place END) AS l90,
      CAST(floor(CAST(sum(length * length) AS DOUBLE) / CAST(sum(length) AS DOUBLE)) AS BIGINT) AS aun FROM (
        SELECT length, row_number() OVER w AS place, sum(length) OVER w AS upto, sum(length) OVER () AS total
        FROM (SELECT contig_id, max(start + len) - min(start) AS length FROM tl GROUP BY contig_id) WINDOW w AS (ORDER BY length DESC, contig_id))""",
    "assemble": f"""SELECT CAST(1 AS BIGINT) AS contig_no, hi - lo AS bases, length(regexp_replace({_genome('lo', 'hi')}, '[AT]', '', 'g')) AS gc FROM box""",
}
BODIES["robust_positions_weighted"] = BODIES["robust_positions"]


def _needed(body: str) -> list[str]:
    """Shared tables a query reaches, in order of definition."""
    import re

    names, queue = set(), [body]
    while queue:
        for word in re.findall(r"[a-z_0-9]+", queue.pop()):
            if word in CTES and word not in names:
                names.add(word)
                queue.append(CTES[word])
    return [n for n in CTES if n in names]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        shared = ", ".join(f"{n} AS ({CTES[n]})" for n in _needed(body))
        out[name] = f"WITH RECURSIVE {shared} SELECT * FROM ({body})"
    return out
