"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandfold import api
from strandfold.functions import cigar as C
from strandfold.functions import sequence as S
from strandfold.operators import bundles, consensus, coverage, extract, fixtures, neighbors, pairs
from strandfold.operators.clusters import check, clusters
from strandfold.operators.shared import shared_dir
from strandfold.plans import sql as Q
from strandfold.sources import files, storage
from strandfold.sources.bam import read_bam, write_bam
from strandfold.sources.fasta import first_record
from strandfold.sources.fastq import read_fastq, write_fastq
from strandfold.sources.tsv import read_tsv, write_tsv

SHORT = ["grp_pos", "reverse"]


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.reads(spark, d)


def _umis(spark: SparkSession, d: str) -> DataFrame:
    return bundles.ranked(bundles.umi_counts(_reads(spark, d)))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).withColumn("qname", F.concat(F.lit("r"), F.col("read_ord").cast("string"), F.lit("_"), F.col("umi"), F.when(F.col("read_ord") % 5 == 0, F.lit("/1")).otherwise(F.lit(""))))


def _fastq(spark: SparkSession, d: str, mate: int = 1) -> DataFrame:
    """Reads of the fixture as FASTQ rows: UMI and sequence in one, qualities by arithmetic."""
    r = _reads(spark, d)
    seq = F.concat("umi", "seq", F.lit("GATTACA")) if mate == 1 else F.concat(F.reverse(F.col("umi")), F.lit("CC"), "seq")
    n = 18 if mate == 1 else 13
    qual = F.concat(*[F.substring(F.lit("#+5?DI"), ((F.col("read_ord") + i * mate) % 6 + 1).cast("int"), F.lit(1)) for i in range(n)])
    return r.select("read_ord", F.concat(F.lit("q"), F.col("read_ord").cast("string")).alias("qname"), F.lit("x:1").alias("descr"), seq.alias("seq"), qual.alias("qual"))


# --- functions


def umi_from_qname(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("read_ord", S.umi_from_name(F.col("qname")).alias("umi"))


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ord", S.reverse_complement(F.lower(F.concat("umi", F.lit("N"), "seq"))).alias("rc"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = _umis(spark, d)
    a, b = (r.select(*SHORT, F.col("rank").alias(f"rank_{s}"), F.col("umi").alias(f"umi_{s}")) for s in "ab")
    both = a.join(b, SHORT).where(F.col("rank_b") == F.col("rank_a") + 1)
    letters, packed = S.hamming(F.col("umi_a"), F.col("umi_b")), S.packed_mismatches(S.pack2(F.col("umi_a")), S.pack2(F.col("umi_b")))
    return both.select(*SHORT, "rank_a", letters.cast("long").alias("letters"), packed.cast("long").alias("packed"))


def ngram_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(F.concat("umi", "seq"), 3)
    return _reads(spark, d).select("read_ord", *[F.get(c, i).alias(f"c{i}") for i in range(3)])


def count_threshold(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(1, 3000).withColumn("n", F.col("id").cast("int"))
    one = [n.select("n", F.lit(p).alias("percent"), S.count_threshold(p / 100, F.col("n")).cast("long").alias("most")) for p in (1, 10, 29, 50, 57, 100)]
    out = one[0]
    for x in one[1:]:
        out = out.union(x)
    return out


def group_position(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.alignments(spark, d).withColumn("ops", C.operations(F.col("cigar")))
    reverse = F.col("flag").bitwiseAND(F.lit(16)) != 0
    return a.select("read_ord", "cigar", reverse.alias("reverse"), C.group_position(F.col("pos"), F.col("ops"), reverse).alias("grp_pos"), C.reference_end(F.col("pos"), F.col("ops")).alias("ref_end"))


def group_length(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.alignments(spark, d).withColumn("ops", C.operations(F.col("cigar")))
    return a.select("read_ord", C.query_length(F.col("ops")).alias("grp_len"), C.window_chunk(F.col("pos"), 50).alias("chunk"))


def cigar_spans(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.alignments(spark, d)
    b = F.explode(C.aligned_blocks(F.col("pos"), C.operations(F.col("cigar"))))
    return a.select("read_ord", b.alias("b")).groupBy("read_ord").agg(F.sum("b.len").cast("long").alias("aligned"), F.count("*").alias("blocks"), F.max(F.col("b.ref") + F.col("b.len")).alias("last_end"), F.max("b.query").alias("last_query"))


def quality_sums(spark: SparkSession, d: str) -> DataFrame:
    return _fastq(spark, d).select("read_ord", S.ascii_sum(F.col("qual")).alias("ascii_sum"), S.quality_sum(F.col("qual").cast("binary")).alias("byte_sum"))


# --- bundles and graph


def umi_counts(spark: SparkSession, d: str) -> DataFrame:
    return bundles.umi_counts(_reads(spark, d)).select(*SHORT, "umi", "n_reads", "first_ord")


def umi_rank(spark: SparkSession, d: str) -> DataFrame:
    return _umis(spark, d).select(*SHORT, "umi", "n_reads", F.col("rank").cast("long").alias("rank"))


def _edges(k: int, rev: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return neighbors.edges(_umis(spark, d), k, 0.5, rev).select(*SHORT, F.col("u_rank").cast("long").alias("u_rank"), F.col("v_rank").cast("long").alias("v_rank"))

    return run


def _cluster(method: str, k: int = 1, percentage: float = 0.5, rev: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = clusters(_umis(spark, d), method, k, percentage, rev)
        return c.select(*SHORT, "umi", "n_reads", F.col("label_rank").cast("long").alias("label_rank"), "leader")

    return run


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = consensus.sizes(consensus.cluster_reads(_reads(spark, d)))
    return s.select(*SHORT, F.col("label_rank").cast("long").alias("label_rank"), "leader", "n_reads", "n_umis")


def _dedup(method: str, min_depth: int = 3, by_length: bool = False, k: int = 1, rev: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _reads(spark, d)
        if by_length:
            r = r.withColumn("grp_len", F.col("read_ord") % 3)
        labels = consensus.cluster_reads(r, method, k, 0.5, rev)
        return consensus.winners(r, labels, min_depth).select(*SHORT, "grp_len", "leader", "n_reads", "seq", "votes", "read_ord", "qual_sum")

    return run


def group_only(spark: SparkSession, d: str) -> DataFrame:
    out, _ = consensus.dedup(_reads(spark, d), only_group=True)
    return out.select("read_ord", *SHORT, "umi", F.col("bx").alias("leader"))


def group_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = consensus.dedup(_reads(spark, d))
    return report


def paired_mates(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.alignments(spark, d)
    keyed = bundles.keyed_alignments(bundles.first_mates(a, paired=True).withColumn("seq", F.col("qname")).withColumn("qual", F.lit(b"I")))
    out, _ = consensus.dedup(keyed, min_depth=1)
    return pairs.with_mates(out.select("read_ord", "qname", "flag", "chr", "pos"), a.select("read_ord", "qname", "flag", "chr", "pos"))


def coverage_by_reference(spark: SparkSession, d: str) -> DataFrame:
    refs = spark.range(6).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chr_name"), F.lit(6000).cast("long").alias("length"))
    out = coverage.coverage(_with_bases(fixtures.alignments(spark, d)), refs)
    return out.select("rname", "endpos", "numreads", "covbases", *[F.round(c, 6).alias(c) for c in ("coverage", "meandepth", "meanbaseq", "meanmapq")])


# --- extraction


def _extract(pattern: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return extract.extract(_fastq(spark, d), pattern, **options)

    return run


def extract_paired(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_pairs(_fastq(spark, d), _fastq(spark, d, 2), "NNNXXXCC", "NNC")


# --- pairs

REFERENCE = "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(1500))


def _overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Two reads an order over a made-up reference, forward and reverse, with the barcode of the fixture."""
    r = _reads(spark, d).select("read_ord", F.col("umi").alias("bx"))
    start = F.col("read_ord") * 13 % 1400
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    r = r.select("*", side, start.alias("start"))
    pos = F.col("start") + F.col("side") * (5 + F.col("read_ord") % 25)
    seq = F.substring(F.lit(REFERENCE), (pos + 1).cast("int"), F.lit(20))
    spoiled = F.when((F.col("read_ord") % 9 == 0) & (F.col("side") == 1), F.concat(F.translate(F.substring(seq, F.lit(1), F.lit(3)), "ACGT", "CATG"), F.substring(seq, F.lit(4), F.lit(17)))).otherwise(seq)
    return r.select(
        (F.col("read_ord") * 2 + F.col("side")).alias("read_ord"), F.concat(F.lit("p"), F.col("read_ord").cast("string")).alias("qname"), (F.col("side") * 16).alias("flag"), F.lit(0).alias("chr"),
        pos.alias("pos"), F.lit("20M").alias("cigar"), spoiled.alias("seq"), F.lit(b"I" * 20).alias("qual"), F.concat(F.col("read_ord").cast("string"), F.lit("-"), F.col("bx")).alias("bx"),
    )


def pair_merge(spark: SparkSession, d: str) -> DataFrame:
    return pairs.merge_pairs(_overlapping(spark, d), None, 3).select("read_ord", "qname", "pos", "cigar", "seq", "status")


def pair_realign(spark: SparkSession, d: str) -> DataFrame:
    return pairs.merge_pairs(_overlapping(spark, d), REFERENCE, 3).select("read_ord", "qname", "pos", "cigar", "seq", "status")


def merge_report(spark: SparkSession, d: str) -> DataFrame:
    r = _overlapping(spark, d)
    return pairs.merge_report(pairs.merge_pairs(r, None, 3), r)


# --- bundles of files


def _named_fastq(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ rows of four lengths with the UMI in the name, as extraction leaves them."""
    n = (8 + F.col("read_ord") % 4).cast("int")
    r = _fastq(spark, d).join(_reads(spark, d).select("read_ord", "umi"), "read_ord")
    return r.select("read_ord", F.concat("qname", F.lit("_"), "umi").alias("qname"), F.substring("seq", F.lit(7), n).alias("seq"), F.substring("qual", F.lit(7), n).cast("binary").alias("qual"))


def _dedup_fastq(by_length: bool = False, compat: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = bundles.keyed_fastq(_named_fastq(spark, d), by_length=by_length, compat=compat)
        labels = consensus.cluster_reads(r, "acyclic", one_bundle=True)
        return consensus.winners(r, labels, 3).select("grp_len", "leader", "n_reads", "seq", "votes", "read_ord", "qual_sum")

    return run


def window_batches(spark: SparkSession, d: str) -> DataFrame:
    a = fixtures.alignments(spark, d)
    return a.select("read_ord", *[C.window_chunk(F.col("pos"), w).alias(f"w{w}") for w in (50, 100, 500)], C.window_chunk(F.col("pos"), None).alias("whole"))


def umi_counts_windows(spark: SparkSession, d: str) -> DataFrame:
    """Reads of one position and UMI are told apart by the batch of windows that their start lies in."""
    a = bundles.first_mates(fixtures.alignments(spark, d), paired=True)
    k = bundles.keyed_alignments(a.withColumn("qual", F.lit(b"I")), split_window=50)
    return bundles.umi_counts(k).select("chr", "window_chunk", "grp_pos", "reverse", "umi", "n_reads", "first_ord")


def option_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Which values of the options are taken."""
    rows = []
    for p in (0.0, 0.009, 0.01, 0.5, 1.0, 1.01):
        rows.append(("percentage", str(p), _taken(lambda p=p: check("directional", 1, p))))
    for w in (None, -50, 0, 1, 50, 500):
        rows.append(("split_window", str(w), _taken(lambda w=w: C.check_window(w))))
    for m in ("raw", "acyclic", "directional", "other"):
        rows.append(("method", m, _taken(lambda m=m: check(m, 1, 0.5))))
    return spark.createDataFrame(rows, "option string, value string, taken boolean")


def _taken(f) -> bool:
    try:
        f()
    except ValueError:
        return False
    return True


def group_tags(spark: SparkSession, d: str) -> DataFrame:
    """One tag a cluster: of the bundle and the leader, whatever read carries it."""
    out, _ = consensus.dedup(_reads(spark, d), only_group=True)
    return out.groupBy(*SHORT, "bx", "ug").agg(F.count("*").alias("n_reads"))


# --- files


def _with_bases(a: DataFrame) -> DataFrame:
    """Alignments with bases, and qualities that are the same all along a read."""
    n = C.query_length(C.operations(F.col("cigar"))).cast("int")
    letter = F.chr((33 + F.col("read_ord") % 40).cast("long"))
    return a.withColumns({"seq": F.rpad(F.lit(""), n, "GATC"), "qual": F.rpad(F.lit(""), n, letter).cast("binary"), "mate_chr": F.lit(-1), "mate_pos": F.lit(-1).cast("long"), "tlen": F.lit(0).cast("long"), "tags": F.create_map(F.lit("BX"), F.lit("ACGT"))})


HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{i}\tLN:6000\n" for i in range(5))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fastq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "fastq")
    write_fastq(_fastq(spark, d), path)
    return read_fastq(spark, path).select("qname", "descr", "seq", "qual")


def fastq_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each read in the files, plain and read in ranges, one after the other."""
    path = _path(spark, "fastq")
    write_fastq(_fastq(spark, d).repartition(7, "qual"), path, gzipped=False, files=4)
    r = read_fastq(spark, path, rangebytes=500_000)
    per = r.groupBy("sample").agg(F.count("*").alias("n"))
    before = per.select("sample", F.coalesce(F.sum("n").over(Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return r.join(before, "sample").select((F.col("before") + F.col("read_ord")).alias("place"), "qname", "seq")


def bam_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "bam")
    write_bam(_with_bases(fixtures.alignments(spark, d)), path, HEADER)
    back = read_bam(spark, path)
    return back.select("qname", "flag", "chr", "chr_name", "pos", "mapq", "cigar", "seq", F.decode("qual", "ISO-8859-1").alias("qual"), F.col("tags")["BX"].alias("bx"))


def bam_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each read in the files: by reference, position and first appearance."""
    path = _path(spark, "bam")
    write_bam(_with_bases(fixtures.alignments(spark, d)).repartition(5, "cigar"), path, HEADER)
    r = read_bam(spark, path)
    return r.select(F.row_number().over(Window.partitionBy("chr").orderBy("sample", "read_ord")).cast("long").alias("place"), "chr", "qname", "flag", "pos")


def bam_region(spark: SparkSession, d: str) -> DataFrame:
    """Reads of one reference and a span of positions: the filters reach the decoder, and the index the files' ranges."""
    path = _path(spark, "bam")
    write_bam(_with_bases(fixtures.alignments(spark, d)), path, HEADER)
    return read_bam(spark, path).where("chr = 2 and pos >= 100 and pos < 400 and flag < 100").select("qname", "flag", "chr", "pos", "cigar")


def tagged_bam(spark: SparkSession, d: str) -> DataFrame:
    """All reads of passing clusters with their leader and cluster tag, as they come back from a BAM."""
    r = _reads(spark, d).withColumns({"qname": F.concat(F.lit("t"), F.col("read_ord").cast("string")), "flag": F.when(F.col("reverse"), 16).otherwise(0), "chr": F.lit(1), "pos": F.col("grp_pos"), "cigar": F.lit("5M")})
    out, _ = consensus.dedup(r, only_group=True)
    path = _path(spark, "bam")
    write_bam(out.select("read_ord", "qname", "flag", "chr", "pos", "cigar", "seq", F.lit(b"IIIII").alias("qual"), "bx", "ug"), path, HEADER)
    return read_bam(spark, path).select("qname", "flag", "pos", "seq", F.col("tags")["BX"].alias("bx"), F.col("tags")["UG"].alias("ug"))


def coverage_tsv(spark: SparkSession, d: str) -> DataFrame:
    """From a BAM to the report in a file, and back."""
    path = _path(spark, "bam")
    write_bam(_with_bases(fixtures.alignments(spark, d)), f"{path}/in", HEADER, files=1)
    failed = {f: e for f, e in api.coverage_files(spark, f"{path}/in", f"{path}/out").items() if e}
    if failed:
        raise RuntimeError(str(failed))
    out = read_tsv(spark, f"{path}/out/part-00000_coverage.tsv", "rname string, startpos int, endpos long, numreads long, covbases long, coverage double, meandepth double, meanbaseq double, meanmapq double")
    return out.select("rname", "startpos", "endpos", "numreads", "covbases", *[F.round(c, 6).alias(c) for c in ("coverage", "meandepth", "meanbaseq", "meanmapq")])


def report_tsv(spark: SparkSession, d: str) -> DataFrame:
    report, path = group_report(spark, d), f"{_path(spark, 'report')}/x_dedup_report.tsv"
    write_tsv(report, path)
    return read_tsv(spark, path, ", ".join(f"{c} {t}" for c, t in report.dtypes))


def fasta_first(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_path(spark, 'fasta')}/r.fa.gz"
    lines = "".join(f"{REFERENCE[i : i + 60]}\n" for i in range(0, len(REFERENCE), 60))
    with storage.writer(path) as f:
        f.write(gzip.compress(f">one two\n{lines}>other\nACGT\n".encode()))
    return spark.createDataFrame([first_record(path)], "name string, seq string")


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder that are taken, their kind, and what the results are called."""
    path = _path(spark, "names")
    for n in ("b.bam", "a.fastq.gz", "c.fq", "d.fastq", "e.fq.gz", "f.txt", ".g.bam"):
        with storage.writer(f"{path}/{n}") as f:
            f.write(b"")
    rows = [(f.rpartition("/")[2], k, files.output_name(f, "directional", "/out"), files.report_name(f, "dedup", "/out")) for f, k in files.gather(path)]
    return spark.createDataFrame(rows, "name string, kind string, output string, report string")


QUERIES = {
    "umi_from_qname": umi_from_qname, "reverse_complement": reverse_complement, "hamming_pairs": hamming_pairs, "ngram_chunks": ngram_chunks, "count_threshold": count_threshold, "quality_sums": quality_sums,
    "group_position": group_position, "group_length": group_length, "cigar_spans": cigar_spans,
    "umi_counts": umi_counts, "umi_rank": umi_rank, "umi_edges": _edges(1), "umi_edges_k2": _edges(2), "umi_edges_rev": _edges(1, True),
    "cluster_raw": _cluster("raw"), "cluster_acyclic": _cluster("acyclic"), "cluster_directional": _cluster("directional"), "cluster_directional_k2": _cluster("directional", 2),
    "cluster_directional_rev": _cluster("directional", rev=True), "cluster_directional_pct10": _cluster("directional", percentage=0.1),
    "cluster_sizes": cluster_sizes, "dedup_directional": _dedup("directional"), "dedup_acyclic": _dedup("acyclic"), "dedup_raw": _dedup("raw"), "dedup_by_length": _dedup("directional", by_length=True), "dedup_singletons": _dedup("directional", 1),
    "group_only": group_only, "group_report": group_report, "paired_mates": paired_mates, "coverage_by_reference": coverage_by_reference,
    "extract_barcodes": _extract("NNXXXXNNCC"), "extract_run_length": _extract("4N2C3X"), "extract_mask": _extract("NNNNNNXX", mask_qual=15), "extract_quality_filter": _extract("NNXX", quality_filter=15),
    "extract_retain_seq": _extract("NNNXXC", retain_seq=True), "extract_retain_compat": _extract("NNNXXC", retain_seq=True, compat=True), "extract_paired": extract_paired,
    "pair_merge": pair_merge, "pair_realign": pair_realign, "merge_report": merge_report, "fastq_roundtrip": fastq_roundtrip, "bam_roundtrip": bam_roundtrip,
    "dedup_fastq": _dedup_fastq(), "dedup_fastq_by_length": _dedup_fastq(True), "dedup_fastq_compat": _dedup_fastq(True, True), "window_batches": window_batches, "umi_counts_windows": umi_counts_windows,
    "option_ranges": option_ranges, "group_tags": group_tags, "fastq_order": fastq_order, "bam_order": bam_order, "bam_region": bam_region, "tagged_bam": tagged_bam, "coverage_tsv": coverage_tsv, "report_tsv": report_tsv,
    "fasta_first": fasta_first, "file_names": file_names,
}
SQL = Q.SQL
