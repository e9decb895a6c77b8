"""The same queries in DuckDB's SQL."""

from __future__ import annotations


def _pos(x: str, start: int, n: int) -> str:
    return f"substr({x}, {start}, {n})"


_BASE = ", ".join(f"substr('ACGT', CAST(1 + (x // {4**i}) % 4 AS INT), 1)" for i in range(6)).replace(", substr", " || substr")

READS = f"""
b AS (SELECT o_orderkey AS read_ord, o_custkey // 30 AS grp_pos, o_custkey % 2 = 1 AS reverse, (o_custkey * 37 + 11) % 4096 AS t,
        o_orderkey % 7 = 0 AS err, CAST(pow(4, o_orderkey % 6) AS BIGINT) AS p4, 1 + (o_orderkey // 7) % 3 AS sh FROM orders),
x AS (SELECT read_ord, grp_pos, reverse, CASE WHEN err THEN t + (((t // p4) % 4 + sh) % 4 - (t // p4) % 4) * p4 ELSE t END AS x FROM b),
reads AS (SELECT read_ord, grp_pos, reverse, {_BASE} AS umi,
        'ACGT' || substr('ACGT', CAST(1 + (read_ord // 7) % 3 AS INT), 1) AS seq, 20 + read_ord % 21 AS qual_sum FROM x)"""

UMIS = """
cnt AS (SELECT grp_pos, reverse, grp_len, umi, count(*) AS n_reads, min(read_ord) AS first_ord FROM keyed GROUP BY ALL),
umis AS (SELECT *, row_number() OVER (PARTITION BY grp_pos, reverse, grp_len ORDER BY n_reads DESC, first_ord, umi) AS rank FROM cnt)"""

_KEY = "grp_pos, reverse, grp_len"
_RC = "reverse(translate(u.umi, 'ACGT', 'TGCA'))"


def _keyed(length: str = "CAST(0 AS BIGINT)") -> str:
    return f"keyed AS (SELECT *, {length} AS grp_len FROM reads)"


def _threshold(p: float, n: str) -> str:
    return f"CAST(trunc(CAST({p} AS FLOAT) * CAST({n} + 1 AS FLOAT)) AS BIGINT)"


def _edges(k: int = 1, p: float = 0.5, rev: bool = False) -> str:
    near = f"(hamming(u.umi, v.umi) <= {k} AND v.n_reads <= {_threshold(p, 'u.n_reads')})"
    if rev:
        near += f" OR v.umi = {_RC} OR (hamming({_RC}, v.umi) <= {k} AND v.n_reads <= {_threshold(p, 'u.n_reads')})"
    return f"""
edges AS (SELECT u.grp_pos, u.reverse, u.grp_len, u.rank AS u_rank, v.rank AS v_rank
        FROM umis u JOIN umis v USING ({_KEY}) WHERE u.rank <> v.rank AND ({near}))"""


def _labels(method: str) -> str:
    if method == "raw":
        return f"lab AS (SELECT {_KEY}, rank, rank AS label_rank FROM umis)"
    if method == "acyclic":
        return f"""
lab AS (SELECT {_KEY}, u.rank, least(u.rank, coalesce(min(e.u_rank), u.rank)) AS label_rank
        FROM umis u LEFT JOIN edges e ON e.grp_pos = u.grp_pos AND e.reverse = u.reverse AND e.grp_len = u.grp_len AND e.v_rank = u.rank
        GROUP BY u.grp_pos, u.reverse, u.grp_len, u.rank)""".replace(f"SELECT {_KEY}", "SELECT u.grp_pos, u.reverse, u.grp_len")
    return f"""
walk AS (SELECT {_KEY}, rank AS root, rank FROM umis
        UNION SELECT w.grp_pos, w.reverse, w.grp_len, w.root, e.v_rank FROM walk w
        JOIN edges e ON e.grp_pos = w.grp_pos AND e.reverse = w.reverse AND e.grp_len = w.grp_len AND e.u_rank = w.rank),
lab AS (SELECT {_KEY}, rank, min(root) AS label_rank FROM walk GROUP BY ALL)"""


def _clusters(method: str = "directional", k: int = 1, p: float = 0.5, rev: bool = False, length: str = "CAST(0 AS BIGINT)") -> str:
    return f"""WITH RECURSIVE {READS}, {_keyed(length)}, {UMIS}, {_edges(k, p, rev)}, {_labels(method)},
clu AS (SELECT u.*, l.label_rank, first_value(u.umi) OVER (PARTITION BY u.grp_pos, u.reverse, u.grp_len, l.label_rank ORDER BY u.rank) AS leader
        FROM umis u JOIN lab l ON l.grp_pos = u.grp_pos AND l.reverse = u.reverse AND l.grp_len = u.grp_len AND l.rank = u.rank),
siz AS (SELECT {_KEY}, label_rank, leader, CAST(sum(n_reads) AS BIGINT) AS n_reads, count(*) AS n_umis FROM clu GROUP BY ALL)"""


def _cluster(*a, **k) -> str:
    return _clusters(*a, **k) + " SELECT grp_pos, reverse, umi, n_reads, label_rank, leader FROM clu"


def _dedup(method: str = "directional", depth: int = 3, length: str = "CAST(0 AS BIGINT)") -> str:
    return (
        _clusters(method, length=length)
        + f""",
per AS (SELECT r.grp_pos, r.reverse, r.grp_len, c.label_rank, c.leader, c.umi, r.seq, count(*) AS n, max(r.qual_sum) AS q, min(r.read_ord) AS seen
        FROM keyed r JOIN clu c ON c.grp_pos = r.grp_pos AND c.reverse = r.reverse AND c.grp_len = r.grp_len AND c.umi = r.umi GROUP BY ALL),
vot AS (SELECT {_KEY}, label_rank, leader, seq, CAST(sum(CASE WHEN umi = leader THEN n ELSE 1 END) AS BIGINT) AS votes, max(q) AS qual_sum,
        min(CASE WHEN umi = leader THEN 0 ELSE 1 END) AS side, min(CASE WHEN umi = leader THEN seen END) AS lead_seen, min(seen) AS any_seen FROM per GROUP BY ALL),
win AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, label_rank ORDER BY votes DESC, qual_sum DESC, side, coalesce(lead_seen, any_seen)) AS k FROM vot),
ord AS (SELECT c.grp_pos, c.reverse, c.grp_len, c.label_rank, r.seq, min(r.read_ord) AS read_ord
        FROM keyed r JOIN clu c ON c.grp_pos = r.grp_pos AND c.reverse = r.reverse AND c.grp_len = r.grp_len AND c.umi = r.umi
        JOIN win w ON w.grp_pos = c.grp_pos AND w.reverse = c.reverse AND w.grp_len = c.grp_len AND w.label_rank = c.label_rank AND w.seq = r.seq AND w.qual_sum = r.qual_sum AND w.k = 1
        GROUP BY ALL)
SELECT s.grp_pos, s.reverse, s.grp_len, s.leader, s.n_reads, w.seq, w.votes, o.read_ord, w.qual_sum
FROM siz s JOIN win w ON w.grp_pos = s.grp_pos AND w.reverse = s.reverse AND w.grp_len = s.grp_len AND w.label_rank = s.label_rank AND w.k = 1
JOIN ord o ON o.grp_pos = s.grp_pos AND o.reverse = s.reverse AND o.grp_len = s.grp_len AND o.label_rank = s.label_rank AND o.seq = w.seq
WHERE s.n_reads >= {depth}"""
    )


_QUAL = "({})".format(" || ".join("substr('#+5?DI', CAST((read_ord + {i} * {m}) % 6 + 1 AS INT), 1)".replace("{i}", str(i)) for i in range(18)))
_QUAL2 = "({})".format(" || ".join(f"substr('#+5?DI', CAST((read_ord + {i} * 2) % 6 + 1 AS INT), 1)" for i in range(13)))
FASTQ = f"""{READS},
fq AS (SELECT read_ord, 'q' || read_ord AS qname, 'x:1' AS descr, umi || seq || 'GATTACA' AS seq, {_QUAL.replace("{m}", "1")} AS qual FROM reads),
fq2 AS (SELECT read_ord, 'q' || read_ord AS qname, 'x:1' AS descr, reverse(umi) || 'CC' || seq AS seq, {_QUAL2} AS qual FROM reads)"""


def _take(x: str, pattern: str, kind: str, mask: int = 0) -> str:
    parts = []
    for i, c in enumerate(pattern):
        if c == kind:
            base = f"substr({x}, {i + 1}, 1)"
            parts.append(f"CASE WHEN ord(substr(qual, {i + 1}, 1)) - 33 < {mask} THEN 'N' ELSE {base} END" if mask else base)
    return "(" + " || ".join(parts) + ")" if parts else "''"


def _part(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN '' ELSE '_' || {x} END)"


def _extract(pattern: str, mask: int = 0, least: int = 0, retain: bool = False, compat: bool = False) -> str:
    cell, umi = _take("seq", pattern, "C"), _take("seq", pattern, "N", mask)
    rest = lambda x: (f"{_take(x, pattern, 'X')} || {x}" if compat else x) if retain else f"{_take(x, pattern, 'X')} || substr({x}, {len(pattern) + 1})"
    low = " OR ".join(f"ord(substr(qual, {i + 1}, 1)) - 33 < {least}" for i, c in enumerate(pattern) if c == "N")
    where = f" WHERE NOT ({low})" if least else ""
    return f"WITH {FASTQ} SELECT read_ord, qname || {_part(cell)} || {_part(umi)} AS qname, descr, {rest('seq')} AS seq, {rest('qual')} AS qual, {cell} AS cell, {umi} AS umi FROM fq{where}"


def _paired() -> str:
    p1, p2 = "NNNXXXCC", "NNC"
    t = lambda x, p, k: f"coalesce({_take(x, p, k)}, '')"
    return f"""WITH {FASTQ}, z AS (SELECT a.read_ord, a.qname AS n1, a.descr AS d1, a.seq AS s1, a.qual AS q1, b.qname AS n2, b.descr AS d2, b.seq AS s2, b.qual AS q2
        FROM fq a LEFT JOIN fq2 b USING (read_ord)),
y AS (SELECT *, {t("s1", p1, "C")} || {t("s2", p2, "C")} AS cell, {t("s1", p1, "N")} || {t("s2", p2, "N")} AS umi FROM z)
SELECT read_ord, n1 || '_' || cell || '_' || umi AS qname1, d1 AS descr1, {_take("s1", p1, "X")} || substr(s1, 9) AS seq1, {_take("q1", p1, "X")} || substr(q1, 9) AS qual1,
       n2 || '_' || cell || '_' || umi AS qname2, d2 AS descr2, substr(s2, 4) AS seq2, substr(q2, 4) AS qual2, cell, umi FROM y"""


ALIGN = """
al AS (SELECT o_orderkey AS read_ord, 'r' || h || '_' || substr('ACGT', CAST(h % 4 + 1 AS INT), 1) || 'CA' || substr('ACGT', CAST(h // 4 % 4 + 1 AS INT), 1) AS qname,
    CAST((CASE WHEN o_custkey % 2 = 0 THEN 16 ELSE 0 END) + (CASE WHEN o_orderkey % 2 = 1 THEN 128 ELSE 64 END) + (CASE WHEN h % 11 = 0 THEN 8 ELSE 0 END) AS INT) AS flag,
    o_custkey % 2 = 0 AS reverse, CAST(h % 5 AS INT) AS chr, 'chr' || (h % 5) AS chr_name, h * 7 % 900 AS pos, CAST(20 + o_custkey % 41 AS INT) AS mapq,
    CASE WHEN h % 3 = 0 THEN 1 + o_custkey % 4 ELSE 0 END AS lead, 10 + o_custkey % 20 AS m1, o_custkey // 2 % 4 AS kind,
    CASE kind WHEN 0 THEN 2 ELSE 0 END AS ins, CASE kind WHEN 1 THEN 3 WHEN 2 THEN 20 ELSE 0 END AS gap, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 0 END AS m2,
    CASE kind WHEN 0 THEN '2I5M' WHEN 1 THEN '3D5M' WHEN 2 THEN '20N7M' ELSE '' END AS mid, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS trail FROM (SELECT *, o_orderkey // 2 AS h FROM orders)),
aln AS (SELECT *, (CASE WHEN lead > 0 THEN lead || 'S' ELSE '' END) || m1 || 'M' || mid || (CASE WHEN trail > 0 THEN '3S' ELSE '' END) AS cigar, pos + m1 + gap + m2 AS ref_end FROM al)"""

_REPORT = (
    _clusters()
    + """,
bun AS (SELECT grp_pos, reverse, count(*) AS groups, sum(n_umis) AS umis, count(*) FILTER (n_reads >= 3) AS good FROM siz GROUP BY ALL HAVING count(*) FILTER (n_reads >= 3) > 0),
pas AS (SELECT * FROM siz WHERE n_reads >= 3)
SELECT (SELECT count(*) FROM reads) AS num_reads_input_file, CAST(sum(good) AS BIGINT) AS num_reads_output_file, CAST(sum(umis) AS BIGINT) AS num_total_barcodes, CAST(sum(groups) AS BIGINT) AS num_total_groups,
    CAST(sum(good) AS BIGINT) AS num_passing_groups, (SELECT leader FROM pas ORDER BY n_reads, reverse, grp_pos, leader LIMIT 1) AS min_reads_group, (SELECT min(n_reads) FROM pas) AS min_reads_per_group,
    (SELECT leader FROM pas ORDER BY n_reads DESC, reverse, grp_pos, leader LIMIT 1) AS max_reads_group, (SELECT max(n_reads) FROM pas) AS max_reads_per_group FROM bun"""
)

_CHUNK = "SELECT read_ord, substr(s, 1, 4) AS c0, substr(s, 5, 4) AS c1, substr(s, 9) AS c2 FROM (SELECT read_ord, umi || seq AS s FROM reads)"

_OVER = """
r AS (SELECT read_ord AS o, umi, read_ord * 13 % 1400 AS s, 5 + read_ord % 25 AS gap FROM reads)"""


def _reference() -> str:
    return "'" + "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(1500)) + "'"


def _merged() -> str:
    ref = _reference()
    return f"""WITH {READS}, {_OVER},
p AS (SELECT *, s + gap AS t, substr({ref}, CAST(s + 1 AS INT), 20) AS a, substr({ref}, CAST(s + gap + 1 AS INT), 20) AS b0 FROM r),
q AS (SELECT *, CASE WHEN o % 9 = 0 THEN translate(substr(b0, 1, 3), 'ACGT', 'CATG') || substr(b0, 4) ELSE b0 END AS b FROM p),
z AS (SELECT *, CASE WHEN gap > 20 THEN 'unmerged' WHEN gap < 20 AND o % 9 = 0 THEN 'discordant' WHEN 20 - gap >= 3 THEN 'merged' ELSE 'unmerged' END AS status FROM q)"""


def _coverage(refs: range) -> str:
    return f"""WITH {ALIGN}, blk AS (SELECT chr_name, pos AS a, pos + m1 AS b, m1 AS n, 33 + read_ord % 40 AS q FROM aln UNION ALL SELECT chr_name, pos + m1 + gap, pos + m1 + gap + m2, m2, 33 + read_ord % 40 FROM aln WHERE m2 > 0),
        own AS (SELECT chr_name, count(*) AS numreads, avg(mapq) AS meanmapq FROM aln GROUP BY 1), per AS (SELECT chr_name, sum(n) AS bases, sum(n * q) AS quality FROM blk GROUP BY 1),
        cov AS (SELECT chr_name, count(DISTINCT p) AS covbases FROM (SELECT chr_name, unnest(generate_series(a, b - 1)) AS p FROM blk) GROUP BY 1), refs AS (SELECT 'chr' || i AS chr_name FROM generate_series(0, {refs[-1]}) t(i))
        SELECT chr_name AS rname, CAST(6000 AS BIGINT) AS endpos, coalesce(numreads, 0) AS numreads, coalesce(covbases, 0) AS covbases, round(100.0::DOUBLE * coalesce(covbases, 0) / 6000, 6) AS coverage,
               round(coalesce(bases, 0)::DOUBLE / 6000, 6) AS meandepth, round(coalesce(quality::DOUBLE / bases, 0), 6) AS meanbaseq, round(coalesce(meanmapq, 0), 6) AS meanmapq
        FROM refs LEFT JOIN own USING (chr_name) LEFT JOIN per USING (chr_name) LEFT JOIN cov USING (chr_name)"""


_UMI_OF = "string_split(qname, '_')[2]"


def _dedup_fastq(length: str) -> str:
    """As _dedup("acyclic"), with all reads in one bundle a length."""
    sql = _dedup("acyclic", length=length)
    rows = f"reads AS (SELECT read_ord, CAST(1 AS BIGINT) AS grp_pos, false AS reverse, umi, substr(s, 7, CAST(8 + read_ord % 4 AS INT)) AS seq, list_sum(list_transform(string_split(substr(q, 7, CAST(8 + read_ord % 4 AS INT)), ''), lambda c: ord(c))) AS qual_sum FROM (SELECT read_ord, umi, umi || seq || 'GATTACA' AS s, {_QUAL.replace('{m}', '1')} AS q FROM raw))"
    sql = sql.replace("reads AS (SELECT", "raw AS (SELECT", 1).replace("keyed AS (", rows + ", keyed AS (", 1)
    return f"SELECT grp_len, leader, n_reads, seq, votes, read_ord, CAST(qual_sum AS BIGINT) AS qual_sum FROM ({sql})"


_TAG = "substr(sha256(concat_ws(chr(31), '', '1', CASE WHEN reverse THEN 'true' ELSE 'false' END, '0', CAST(grp_pos AS VARCHAR), '0', leader)), 1, 8)"
_PASSING = ", pas AS (SELECT * FROM siz WHERE n_reads >= 3), own AS (SELECT r.read_ord, r.grp_pos, r.reverse, r.umi, r.seq, c.leader FROM reads r JOIN clu c USING (grp_pos, reverse, umi) JOIN pas p USING (grp_pos, reverse, label_rank))"


SQL = {
    "umi_from_qname": f"WITH {READS} SELECT read_ord, umi FROM reads",
    "reverse_complement": f"WITH {READS} SELECT read_ord, reverse(translate(umi || 'N' || seq, 'ACGT', 'TGCA')) AS rc FROM reads",
    "hamming_pairs": f"""WITH {READS}, {_keyed()}, {UMIS} SELECT a.grp_pos, a.reverse, CAST(a.rank AS INT) AS rank_a, hamming(a.umi, b.umi) AS letters, hamming(a.umi, b.umi) AS packed
        FROM umis a JOIN umis b ON a.grp_pos = b.grp_pos AND a.reverse = b.reverse AND b.rank = a.rank + 1""",
    "ngram_chunks": f"WITH {READS} {_CHUNK}",
    "count_threshold": f"SELECT CAST(n AS INT) AS n, CAST(p AS INT) AS percent, CAST(trunc(CAST(p / 100.0 AS FLOAT) * CAST(n + 1 AS FLOAT)) AS BIGINT) AS most FROM generate_series(1, 2999) t(n), (VALUES (1), (10), (29), (50), (57), (100)) v(p)",
    "quality_sums": f"WITH {FASTQ} SELECT read_ord, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ord(c))) AS BIGINT) AS ascii_sum, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ord(c))) AS BIGINT) AS byte_sum FROM fq",
    "group_position": f"WITH {ALIGN} SELECT read_ord, cigar, reverse, CASE WHEN reverse THEN ref_end + trail ELSE pos - lead END AS grp_pos, ref_end FROM aln",
    "group_length": f"WITH {ALIGN} SELECT read_ord, CAST(lead + m1 + ins + m2 + trail AS BIGINT) AS grp_len, CAST(pos // 150 AS BIGINT) AS chunk FROM aln",
    "cigar_spans": f"WITH {ALIGN} SELECT read_ord, CAST(m1 + m2 AS BIGINT) AS aligned, CAST(CASE WHEN m2 > 0 THEN 2 ELSE 1 END AS BIGINT) AS blocks, ref_end AS last_end, CAST(CASE WHEN m2 > 0 THEN lead + m1 + ins ELSE lead END AS BIGINT) AS last_query FROM aln",
    "umi_counts": f"WITH {READS}, {_keyed()}, {UMIS} SELECT grp_pos, reverse, umi, n_reads, first_ord FROM umis",
    "umi_rank": f"WITH {READS}, {_keyed()}, {UMIS} SELECT grp_pos, reverse, umi, n_reads, rank FROM umis",
    "umi_edges": f"WITH {READS}, {_keyed()}, {UMIS}, {_edges()} SELECT grp_pos, reverse, u_rank, v_rank FROM edges",
    "umi_edges_k2": f"WITH {READS}, {_keyed()}, {UMIS}, {_edges(2)} SELECT grp_pos, reverse, u_rank, v_rank FROM edges",
    "umi_edges_rev": f"WITH {READS}, {_keyed()}, {UMIS}, {_edges(1, rev=True)} SELECT grp_pos, reverse, u_rank, v_rank FROM edges",
    "cluster_raw": _cluster("raw"),
    "cluster_acyclic": _cluster("acyclic"),
    "cluster_directional": _cluster(),
    "cluster_directional_k2": _cluster(k=2),
    "cluster_directional_rev": _cluster(rev=True),
    "cluster_directional_pct10": _cluster(p=0.1),
    "cluster_sizes": _clusters() + " SELECT grp_pos, reverse, label_rank, leader, n_reads, n_umis FROM siz",
    "dedup_directional": _dedup(),
    "dedup_acyclic": _dedup("acyclic"),
    "dedup_raw": _dedup("raw"),
    "dedup_by_length": _dedup(length="read_ord % 3"),
    "dedup_singletons": _dedup(depth=1),
    "group_only": _clusters() + ", pas AS (SELECT * FROM siz WHERE n_reads >= 3) SELECT r.read_ord, r.grp_pos, r.reverse, r.umi, c.leader FROM reads r JOIN clu c USING (grp_pos, reverse, umi) JOIN pas p USING (grp_pos, reverse, label_rank)",
    "group_report": _REPORT,
    "coverage_by_reference": _coverage(range(6)),
    "coverage_tsv": _coverage(range(5)).replace("CAST(6000 AS BIGINT) AS endpos", "CAST(1 AS INT) AS startpos, CAST(6000 AS BIGINT) AS endpos"),
    "extract_barcodes": _extract("NNXXXXNNCC"),
    "extract_run_length": _extract("NNNNCCXXX"),
    "extract_mask": _extract("NNNNNNXX", mask=15),
    "extract_quality_filter": _extract("NNXX", least=15),
    "extract_retain_seq": _extract("NNNXXC", retain=True),
    "extract_retain_compat": _extract("NNNXXC", retain=True, compat=True),
    "extract_paired": _paired(),
    "pair_merge": _merged()
    + """ SELECT o * 2 AS read_ord, 'p' || o || (CASE WHEN status = 'merged' THEN ':MERGED' ELSE '' END) AS qname, s AS pos, CASE WHEN status = 'merged' THEN (20 + gap) || 'M' ELSE '20M' END AS cigar,
        CASE WHEN status = 'merged' THEN substr(a, 1, CAST(gap AS INT)) || b ELSE a END AS seq, status FROM z
        UNION ALL SELECT o * 2 + 1, 'p' || o, t, '20M', b, 'unmerged' FROM z WHERE status = 'unmerged'""",
    "merge_report": _merged()
    + """ SELECT 2 * count(*) AS num_reads_in, count(*) FILTER (status = 'discordant') AS num_discordant, 2 * count(*) FILTER (status = 'unmerged') AS num_unmerged, count(*) FILTER (status = 'merged') AS num_merged,
        2 * count(*) FILTER (status = 'unmerged') + count(*) FILTER (status = 'merged') AS num_reads_out FROM z""",
    "fastq_roundtrip": f"WITH {FASTQ} SELECT qname, descr, seq, qual FROM fq",
    "bam_roundtrip": f"""WITH {ALIGN}, l AS (SELECT *, CAST(lead + m1 + ins + m2 + trail AS INT) AS n FROM aln)
        SELECT qname, flag, chr, chr_name, pos, mapq, cigar, substr(repeat('GATC', 20), 1, n) AS seq, repeat(chr(CAST(33 + read_ord % 40 AS INT)), n) AS qual, 'ACGT' AS bx FROM l""",
    "pair_realign": _merged()
    + f""" SELECT o * 2 AS read_ord, 'p' || o || (CASE WHEN status = 'merged' THEN ':MERGED' ELSE '' END) AS qname, CASE WHEN status = 'merged' THEN instr({_reference()}, substr(a, 1, CAST(gap AS INT)) || b) - 1 ELSE s END AS pos,
        CASE WHEN status = 'merged' THEN (20 + gap) || '=' ELSE '20M' END AS cigar, CASE WHEN status = 'merged' THEN substr(a, 1, CAST(gap AS INT)) || b ELSE a END AS seq, status FROM z
        UNION ALL SELECT o * 2 + 1, 'p' || o, t, '20M', b, 'unmerged' FROM z WHERE status = 'unmerged'""",
    "dedup_fastq": _dedup_fastq("CAST(0 AS BIGINT)"),
    "dedup_fastq_by_length": _dedup_fastq("CAST(length(seq) AS BIGINT)"),
    "dedup_fastq_compat": _dedup_fastq("CAST(length(seq) % 2 AS BIGINT)"),
    "window_batches": f"WITH {ALIGN} SELECT read_ord, CAST(pos // 150 AS BIGINT) AS w50, CAST(pos // 300 AS BIGINT) AS w100, CAST(pos // 1500 AS BIGINT) AS w500, CAST(0 AS BIGINT) AS whole FROM aln",
    "umi_counts_windows": f"""WITH {ALIGN} SELECT chr, CAST(pos // 150 AS BIGINT) AS window_chunk, CASE WHEN reverse THEN ref_end + trail ELSE pos - lead END AS grp_pos, reverse, {_UMI_OF} AS umi, count(*) AS n_reads, min(read_ord) AS first_ord
        FROM aln WHERE flag & 128 = 0 AND flag & 8 = 0 GROUP BY ALL""",
    "option_ranges": """SELECT * FROM (VALUES ('percentage', '0.0', false), ('percentage', '0.009', false), ('percentage', '0.01', true), ('percentage', '0.5', true), ('percentage', '1.0', true), ('percentage', '1.01', false),
        ('split_window', 'None', true), ('split_window', '-50', false), ('split_window', '0', false), ('split_window', '1', true), ('split_window', '50', true), ('split_window', '500', true),
        ('method', 'raw', true), ('method', 'acyclic', true), ('method', 'directional', true), ('method', 'other', false)) t(option, value, taken)""",
    "group_tags": _clusters() + _PASSING + f" SELECT grp_pos, reverse, leader AS bx, {_TAG} AS ug, count(*) AS n_reads FROM own GROUP BY ALL",
    "tagged_bam": _clusters() + _PASSING + f" SELECT 't' || read_ord AS qname, CAST(CASE WHEN reverse THEN 16 ELSE 0 END AS INT) AS flag, grp_pos AS pos, seq, leader AS bx, {_TAG} AS ug FROM own",
    "fastq_order": f"WITH {FASTQ} SELECT row_number() OVER (ORDER BY read_ord) - 1 AS place, qname, seq FROM fq",
    "bam_order": f"WITH {ALIGN} SELECT row_number() OVER (PARTITION BY chr ORDER BY pos, read_ord) AS place, chr, qname, flag, pos FROM aln",
    "bam_region": f"WITH {ALIGN} SELECT qname, flag, chr, pos, cigar FROM aln WHERE chr = 2 AND pos >= 100 AND pos < 400 AND flag < 100",
    "report_tsv": _REPORT,
    "fasta_first": f"SELECT 'one' AS name, {_reference()} AS seq",
    "file_names": """SELECT * FROM (VALUES ('a.fastq.gz', 'fastq', '/out/a.fastq_directional.gz', '/out/a_dedup_report.tsv'), ('b.bam', 'bam', '/out/b_directional.bam', '/out/b_dedup_report.tsv'), ('c.fq', 'fastq', '/out/c_directional.fq', '/out/c_dedup_report.tsv'),
        ('d.fastq', 'fastq', '/out/d_directional.fastq', '/out/d_dedup_report.tsv'), ('e.fq.gz', 'fastq', '/out/e.fq_directional.gz', '/out/e_dedup_report.tsv')) t(name, kind, output, report)""",
}

SQL["paired_mates"] = f"""WITH RECURSIVE {ALIGN}, k AS (SELECT *, CASE WHEN reverse THEN ref_end + trail ELSE pos - lead END AS gp, string_split(qname, '_')[2] AS umi FROM aln WHERE flag & 128 = 0 AND flag & 8 = 0),
u AS (SELECT chr, reverse, gp, umi, count(*) AS n, min(read_ord) AS f FROM k GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY chr, reverse, gp ORDER BY n DESC, f, umi) AS rank FROM u),
e AS (SELECT a.chr, a.reverse, a.gp, a.rank AS u_rank, b.rank AS v_rank FROM rk a JOIN rk b USING (chr, reverse, gp) WHERE a.rank <> b.rank AND hamming(a.umi, b.umi) <= 1 AND b.n <= {_threshold(0.5, "a.n")}),
walk AS (SELECT chr, reverse, gp, rank AS root, rank FROM rk UNION SELECT w.chr, w.reverse, w.gp, w.root, e.v_rank FROM walk w JOIN e ON e.chr = w.chr AND e.reverse = w.reverse AND e.gp = w.gp AND e.u_rank = w.rank),
lab AS (SELECT chr, reverse, gp, rank, min(root) AS label FROM walk GROUP BY ALL),
clu AS (SELECT r.*, l.label, first_value(r.umi) OVER (PARTITION BY r.chr, r.reverse, r.gp, l.label ORDER BY r.rank) AS leader FROM rk r JOIN lab l USING (chr, reverse, gp, rank)),
per AS (SELECT c.chr, c.reverse, c.gp, c.label, k.qname, sum(CASE WHEN c.umi = c.leader THEN 1 ELSE 0 END) AS nl, count(DISTINCT CASE WHEN c.umi <> c.leader THEN c.umi END) AS nm, min(k.read_ord) AS seen,
        min(CASE WHEN c.umi = c.leader THEN 0 ELSE 1 END) AS side, min(CASE WHEN c.umi = c.leader THEN k.read_ord END) AS ls FROM k JOIN clu c ON c.chr = k.chr AND c.reverse = k.reverse AND c.gp = k.gp AND c.umi = k.umi GROUP BY ALL),
win AS (SELECT *, row_number() OVER (PARTITION BY chr, reverse, gp, label ORDER BY nl + nm DESC, side, coalesce(ls, seen)) AS r FROM per),
o AS (SELECT k.read_ord, k.qname, k.flag, k.chr, k.pos FROM win w JOIN k ON k.read_ord = w.seen WHERE w.r = 1)
SELECT * FROM o UNION ALL SELECT a.read_ord, a.qname, a.flag, a.chr, a.pos FROM aln a WHERE a.flag & 128 <> 0 AND EXISTS (SELECT 1 FROM o WHERE o.chr = a.chr AND o.qname = a.qname)"""
