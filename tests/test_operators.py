"""Small cases and brute-force twins of operators."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regseq.functions import kernels
from regseq.functions import sequence as s
from regseq.operators import aggregates, conservation, graph, joins, motifs, quality, sets, statistics, sweeps, topk
from regseq.plans import conserved
from regseq.sources import writers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_columns(spark):
    assert one(spark, s.gff_attribute(F.lit("Name=a1; ID=gene:b1;ID=gene:c"), "ID=gene:"))[0] == "b1"
    assert one(spark, s.gff_attribute(F.lit("Name=a"), "ID="))[0] is None
    assert one(spark, s.gene_from_description(F.lit("pep gene:AT1 x")), s.gene_from_description(F.lit("pep")))[:] == ("AT1", "unknown")
    assert one(spark, s.mask_iupac(F.lit("aCRt")), s.mask_iupac(F.lit("aCRt"), upper=False))[:] == ("ACNT", "NCNN")
    assert [tuple(x) for x in one(spark, s.windows(F.lit("ACGTA"), 3, 2))[0]] == [(0, "ACG"), (2, "GTA")]
    assert one(spark, s.windows(F.lit("AC"), 3))[0] == []
    assert [tuple(x) for x in one(spark, s.go_terms(F.lit("GO_process: growth; x; GO_component:wall")))[0]] == [("GO_process", "growth"), ("GO_component", "wall")]
    assert sorted(one(spark, s.shuffle_sequence(F.lit("acgt"), 1))[0]) == list("ACGT")
    assert one(spark, s.neg_log10_p(F.lit(0.0)), s.neg_log10_p(F.lit(2.0)))[:] == (20.0, None)
    assert one(spark, s.safe_name(F.lit("a:b,c/d <e>|")))[0] == "a-b-c-d_-e--"
    assert one(spark, s.working_sequence(F.lit("masked"), F.lit("A"), F.lit("N"), F.lit("C")))[0] == "N"


def test_belief_matches_formula(spark):
    x, y = s.belief("s", "r", 78, 100)
    for r in spark.createDataFrame([(float(a), float(b)) for a in range(0, 101, 7) for b in (0, 10, 33, 50, 99, 100)], "s double, r double").select("s", "r", x.alias("b"), y.alias("i")).collect():
        f = min(1.5, 100 / (100 - r.r)) if r.r < 100 else 1.5
        i = min(100, f * (r.s - r.r)) if r.s >= r.r else 0
        b = 0 if i <= 78 else 1 if i >= 100 else 1 / (1 + math.exp(5 - 10 * (i - 78) / 22))
        assert (r.b, r.i) == pytest.approx((b, i))


def test_merge_runs_and_masks(spark):
    runs = spark.createDataFrame([("g", "c", 10, 20, "m1"), ("g", "c", 15, 30, "m2"), ("g", "c", 30, 31, "m3")], "gene_id string, chrom string, lo int, hi int, match string")
    got = sorted((r.lo, r.hi, [tuple(m) for m in r.matches]) for r in sweeps.merge_runs(runs).collect())
    assert got == [(10, 30, [(0, "m1"), (5, "m2")]), (30, 31, [(0, "m3")])]
    iv = spark.createDataFrame([("a", 10, "ACGTACGT")], "id string, lo int, seq string")
    sites = spark.createDataFrame([("a", 8, 12), ("a", 16, 30)], "id string, lo int, hi int")
    assert sweeps.mask_sites(iv, sites).first().seq == "NNGTACNN"
    prof = spark.createDataFrame([("a", 0, 5), ("a", 1, 6)], "id string, offset int, score int")
    rep = spark.createDataFrame([("a", 0, 90.0)], "id string, offset int, repeat_ratio double")
    assert [r.score for r in sweeps.mask_profile(prof, rep, 50.0).orderBy("offset").collect()] == [0, 6]


def test_match_runs(spark):
    r = spark.createDataFrame([("p", 0, 7)], "pair_id string, start int, end int")
    pairs = spark.createDataFrame([("p", 0, 2), ("p", 1, 3), ("p", 3, 0)], "pair_id string, offset1 int, offset2 int")
    got = sorted((x.from1, x.to1, x.from2, x.to2, x.n) for x in sweeps.match_runs(r, r, pairs, 5).collect())
    assert got == [(0, 5, 2, 7, 2), (3, 7, 0, 4, 1)]


def test_top_sites_greedy(spark):
    random.seed(2)
    rows = [(g, random.randrange(200), random.choice("+-"), round(random.random(), 3)) for g in range(4) for _ in range(60)]
    want = set()
    for g in range(4):
        taken = []
        for p, site, strand in sorted((p, x, t) for h, x, t, p in rows if h == g):
            if len(taken) < 5 and all(abs(site - y) >= 10 for _, y, _ in taken):
                taken.append((p, site, strand))
        want |= {(g, k + 1, x, t, p) for k, (p, x, t) in enumerate(taken)}
    got = topk.top_sites(spark.createDataFrame(rows, "interval_idx int, site int, strand string, pvalue double"), 10, 5).collect()
    assert {(r.interval_idx, r.rank, r.site, r.strand, r.pvalue) for r in got} == want
    assert topk.sites_below(spark.createDataFrame(rows, "interval_idx int, site int, strand string, pvalue double"), 0.0, 10).count() == sum(1 for r in want if r[4] == 0.0)
    with pytest.raises(ValueError):
        topk.top_pvalues(spark.createDataFrame(rows[:1], "interval_idx int, site int, strand string, pvalue double"), 2)


def test_pair_sites_greedy(spark):
    rows = [("s", "+", 0, 20, 0.1), ("s", "+", 5, 50, 0.2), ("s", "+", 100, 130, 0.3)]
    got = topk.top_pair_sites(spark.createDataFrame(rows, "seq_id string, strand string, pos_a int, pos_b int, score double"), 8, 8, 5).collect()
    assert [(r.pos_a, r.pos_b) for r in got] == [(0, 20), (100, 130)]


def test_random_intervals(spark):
    seqs = spark.createDataFrame([("a", "ACGT" * 50), ("b", "N" * 100), ("c", "TTTT" * 30)], "id string, seq string")
    lengths = spark.createDataFrame([(i, 10 + i % 7) for i in range(40)], "id long, length int")
    got = topk.random_intervals(lengths, seqs, 30, 0.1, 3).collect()
    assert len(got) == 40 and all(r.chrom != "b" and 0 <= r.lo and r.hi <= (200 if r.chrom == "a" else 120) for r in got)


def test_count_matrix_raises(spark):
    with pytest.raises(ValueError):
        aggregates.count_matrix(spark.createDataFrame([("m", "AC"), ("m", "A")], "motif_id string, seq string"))


def test_merges(spark):
    g = spark.createDataFrame([("x", 1, {"a": "1"}), ("x", 2, {"a": "2", "b": "3"})], "accession string, load_order int, metadata map<string,string>")
    assert aggregates.merge_genes(g).first().metadata == {"a": "1", "b": "3"}
    q = spark.createDataFrame([("i", "d1", "AC", 1), ("i", "d2", "AC", 2)], "identity string, description string, seq string, load_order int")
    a = spark.createDataFrame([("i", "n", "t", 0, 1, 1), ("i", "n", "u", 5, 6, 2)], "identity string, annotation_id string, type string, lo int, hi int, load_order int")
    one_, ann = aggregates.compact_sequences(q, a)
    assert (one_.first().description, ann.first().type) == ("d1", "t")
    u = aggregates.utrs(spark.createDataFrame([("g", 0, 100, "-")], "gene_id string, lo int, hi int, strand string"), spark.createDataFrame([("g", 20, 70)], "gene_id string, lo int, hi int")).first()
    assert u[1:] == (70, 100, 0, 20)
    look = joins.gene_lookup(*(spark.createDataFrame([("s", n, k, k + 1)], "species string, name string, lo int, hi int") for n, k in (("g", 0), ("g", 5), ("h", 9)))).first()
    assert (look.utr5_lo, look.utr3_lo) == (5, None)


def test_thresholds_combination_and_factors(spark):
    thr = spark.createDataFrame([("b", "a", 70, 90)], "sp_lo string, sp_hi string, a int, b int")
    got = joins.pair_thresholds(spark.createDataFrame([("a", "b"), ("a", "z")], "sp1 string, sp2 string"), thr).orderBy("sp2").collect()
    assert [(r.a, r.b) for r in got] == [(70, 90), (None, None)]
    pres = spark.createDataFrame([("g", "s1", "m"), ("g", "s2", "m"), ("g", "s1", "k")], "group_id string, seq_id string, motif string")
    assert {r.motif for r in joins.combine_motifs(pres, 0.9).collect()} == {"m"}
    assert joins.combine_motifs(pres, 0.9, compat=True).count() == 0
    mp = joins.motif_proteins(spark.createDataFrame([("m", ["T00001xyz"])], "motif_id string, factors array<string>"), spark.createDataFrame([("T00001", "P1")], "factor string, accession string"))
    assert mp.first().accession == "P1"


def test_filters(spark):
    mods = spark.createDataFrame([("g", 1, 0, 0.9, "d"), ("g", 1, 1, 0.1, "e"), ("g", 2, 0, 0.1, "d")], "gene_id string, bundle_id int, species_idx int, belief double, db string")
    assert quality.threshold_regions(mods, 0.5).count() == 2
    assert quality.filter_by_db(mods, ["e"]).count() == 1
    genes = spark.createDataFrame([("miRNA",), ("pseudogene",), ("protein_coding",), (None,)], "biotype string")
    assert quality.neighbour_eligible(genes).count() == 2 and quality.neighbour_eligible(genes, True, True).count() == 4
    assert quality.real_accessions(spark.createDataFrame([("__x",), ("y",)], "accession string")).count() == 1
    ann = spark.createDataFrame([("t", "1"), ("u", "2")], "type string, id string")
    assert quality.annotations(ann, "t").count() == 1 and quality.annotations(ann, ids=["2"], predicate=F.col("type") == "u").count() == 1
    assert quality.single_database(mods).first().single is False
    flags = spark.createDataFrame([(1, True), (2, False)], "id int, keep boolean")
    assert sets.subset_by_flag(flags, "keep").count() == 1
    assert sets.ids_overlap(flags, flags.filter("id = 2")) and joins.sets_overlap(*(spark.createDataFrame([("x", "c", 1, 5)], "id string, chrom string, lo int, hi int"),) * 2)
    assert sets.union_sequences(flags, flags).count() == 2 and sets.distinct_ids(flags.union(flags)).count() == 2
    assert topk.first_n(flags, 1, "id").first().id == 1 and topk.last_n(flags, 1, "id").first().id == 2


def test_window_pairs_against_loops(spark):
    random.seed(4)
    a, b = ("".join(random.choice("ACGTN") for _ in range(n)) for n in (90, 70))
    pairs = spark.createDataFrame([("p", a, b), ("q", a, None), ("r", "AC", b)], "pair_id string, seq1 string, seq2 string")
    want = {(i, j, k) for i in range(71) for j in range(51) if (k := sum(x == y != "N" for x, y in zip(a[i : i + 20], b[j : j + 20], strict=True))) >= 6}
    assert {(r.offset1, r.offset2, r.score) for r in conservation.window_pair_scores(pairs, 20, 6).collect()} == want
    old = conservation.STRIP
    conservation.STRIP = 300
    try:
        assert {(r.offset1, r.offset2, r.score) for r in conservation.window_pair_scores(pairs, 20, 6).collect()} == want
    finally:
        conservation.STRIP = old


def test_conserved_regions_finds_a_planted_element(spark):
    random.seed(6)
    rnd = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    core = rnd(80)
    seqs = [("g1", "s1", rnd(100) + core + rnd(50)), ("g2", "s2", rnd(30) + core + rnd(120)), ("g3", "s3", rnd(200))]
    df = spark.createDataFrame([(*x, x[2]) for x in seqs], "gene_id string, species string, seq string, masked_seq string")
    orth = spark.createDataFrame([("g1", "g2"), ("g1", "g3")], "query_gene string, target_gene string")
    got = conserved.conserved_regions(df, orth).collect()
    assert [(r.gene_id, r.species) for r in got] == [("g1", "s2")]
    assert abs(got[0].start - 30) <= 12 and abs(got[0].target_start - 100) <= 12 and got[0].conservation == 60
    assert conserved.conserved_regions(df, orth, pseudo_seed=1).count() <= 2


def _planted(spark, masked=False):
    random.seed(8)
    rnd = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    core = rnd(80)
    seqs = [("g1", "s1", rnd(100) + core + rnd(50)), ("g2", "s2", rnd(30) + core + rnd(120)), ("g3", "s2", rnd(45) + core + rnd(100))]
    rows = [(g, sp, q, "N" * len(q) if masked and g == "g2" else q) for g, sp, q in seqs]
    df = spark.createDataFrame(rows, "gene_id string, species string, seq string, masked_seq string")
    return df, core


def test_two_partners_of_one_species_are_two_comparisons(spark):
    df, core = _planted(spark)
    orth = spark.createDataFrame([("g1", "g2"), ("g1", "g3")], "query_gene string, target_gene string")
    got = {r.partner: r for r in conserved.conserved_regions(df, orth, centre=True).collect()}
    assert set(got) == {"g1", "g2", "g3"} and got["g1"].species == "centre"
    assert 0 <= 30 - got["g2"].start <= 18 and 0 <= 45 - got["g3"].start <= 18
    assert all(core in r.seq and r.repeat_ratio == 0 and r.end - r.start + 1 == len(r.seq) for r in got.values())
    assert got["g1"].conservation is None and got["g1"].belief == 1 and got["g2"].target_start == got["g1"].start
    lines = {r.value for r in writers.cns_tabular(conserved.conserved_regions(df, orth, centre=True)).collect()}
    assert len(lines) == 1 and all(core in x for x in lines)


def test_repeated_rows_and_ambiguous_ids_of_conserved_regions(spark):
    df, _ = _planted(spark)
    orth = spark.createDataFrame([("g1", "g2"), ("g1", "g3")], "query_gene string, target_gene string")
    text = lambda x: sorted(map(str, x.collect()))
    assert text(conserved.conserved_regions(df.union(df), orth.union(orth), centre=True)) == text(conserved.conserved_regions(df, orth, centre=True))
    for other in (F.lit("s9").alias("species"), F.col("species")):
        twice = df.union(df.filter("gene_id = 'g1'").select("gene_id", other, F.concat("seq", F.lit("A")), F.concat("masked_seq", F.lit("A"))))
        with pytest.raises(ValueError, match="g1"):
            conserved.conserved_regions(twice, orth)
    pairs = joins.comparison_pairs(df.union(df.withColumn("species", F.concat("species", F.lit("x")))), orth)
    assert pairs.count() == pairs.select("pair_id").distinct().count() == 8


def test_conserved_regions_written_out(spark):
    """The text of conserved regions, as a reader of the files expects it, line by line."""
    df, _ = _planted(spark)
    seq = {r.gene_id: r.seq for r in df.collect()}
    orth = spark.createDataFrame([("g1", "g2"), ("g1", "g3")], "query_gene string, target_gene string")
    found = conserved.conserved_regions(df, orth, centre=True)
    e = {r.partner: r for r in found.collect()}
    assert len(e) == 3
    fields = [x for g in ("g1", "g2", "g3") for x in (e[g].seq, "" if g == "g1" else str(e[g].conservation), str(e[g].belief))]
    assert [r.value for r in writers.cns_tabular(found).collect()] == ["\t".join(["g1", "g2", "g3", *fields, ""])]
    three = orth.withColumn("species", F.lit("s2")).select(F.col("query_gene").alias("gene_id"), F.lit("+").alias("gene_strand"), "species", F.col("target_gene").alias("partner"), F.lit("-").alias("partner_strand"), F.lit(60).alias("alignmax"))
    lone = three.limit(1).select(F.lit("g9").alias("gene_id"), "gene_strand", "species", F.lit("h").alias("partner"), "partner_strand", "alignmax")
    places = df.select(F.col("gene_id").alias("partner"), F.lit("c").alias("chrom"), F.lit(500).alias("lo"), (F.length("seq") + 500).alias("hi"), F.when(F.col("gene_id") == "g3", "-").otherwise("+").alias("strand"), "seq")
    blocks = {r.value.split("\n")[1]: r.value.split("\n") for r in writers.cns_blocks(conservation.bundles_to_modules(found, places), three.union(lone)).collect()}
    want = ["--PairStart", "g1", "+", "s2", "g2", "-", "60", "s2", "g3", "-", "60", "--RemoStart", "--InnerStart"]
    for g in ("g1", "g2", "g3"):
        r = e[g]
        five, three_ = (501 + r.start, 501 + r.end) if g != "g3" else (500 + len(seq[g]) - r.start, 500 + len(seq[g]) - r.end)
        want += [f"--Organism: {r.species}", r.seq, "-" if g == "g3" else "+", str(five), str(three_), "" if g == "g1" else str(r.conservation), str(r.belief), str(r.repeat_ratio)]
    assert blocks["g1"] == [*want, "--InnerEnd", "--RemoEnd", "--PairEnd"]
    assert blocks["g9"] == ["--PairStart", "g9", "+", "s2", "h", "-", "60", "--RemoStart", "--RemoEnd", "--PairEnd"]
    masked = df.withColumn("masked_seq", F.translate("seq", "A", "N"))
    table = {r.partner: r for r in writers.bundle_table(found, masked).collect()}
    assert set(table) == {"g1", "g2", "g3"} and table["g1"].species == "s1" and table["g1"].target_start is None and table["g2"].target_end == e["g2"].target_end
    assert all(r.piece == e[g].seq and r.masked_piece == r.piece.replace("A", "N") for g, r in table.items())


def test_partner_repeats_lower_belief(spark):
    df, _ = _planted(spark, masked=True)
    orth = spark.createDataFrame([("g1", "g2")], "query_gene string, target_gene string")
    assert conserved.conserved_regions(df, orth).count() == 0


def test_regions_of_a_gene_list_and_of_all(spark):
    random.seed(9)
    chrom = "".join(random.choice("ACGT") for _ in range(1000))
    seqs = spark.createDataFrame([("c1", chrom)], "id string, seq string")
    genes = spark.createDataFrame([("a", "c1", 200, 300, "+"), ("b", "c1", 340, 400, "+"), ("c", "c1", 600, 700, "-")], "name string, chrom string, lo long, hi long, strand string")
    got = {r.gene_id: (r.lo, r.hi, r.seq) for r in conserved.regulatory_regions(genes, seqs, 100).collect()}
    assert got["a"] == (100, 200, chrom[100:200]) and got["b"][:2] == (300, 340) and got["c"][:2] == (700, 800)
    one = conserved.regulatory_regions(genes, seqs, 100, spark.createDataFrame([("b",)], "name string")).collect()
    assert [(r.gene_id, r.lo, r.hi) for r in one] == [("b", 300, 340)]


def test_tails(spark):
    rows = [(i, n, k, p) for i, (n, k, p) in enumerate([(10, 3, 0.2), (10, 0, 0.5), (5, 6, 0.5), (7, 2, 0.0), (7, 2, 1.0), (50, 40, 0.9)])]
    got = {r.key: r.p_value for r in statistics.binom_sf(spark.createDataFrame(rows, "key int, n int, k int, p double")).collect()}
    for i, n, k, p in rows:
        assert got[i] == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(max(k, 0), n + 1)), abs=1e-9)
    z = one(spark, statistics.ks_pvalue(F.lit(0.3), F.lit(200)))[0]
    assert 0 <= z < 1e-6


def test_qvalues_not_below_p(spark):
    rows = [(i, "m", random.random()) for i in range(50)]
    got = statistics.qvalues(spark.createDataFrame(rows, "hit_id int, motif string, pvalue double"), ["motif"]).collect()
    assert all(r.qvalue >= r.pvalue - 1e-12 for r in got)


def test_clusters_equal_one_at_a_time(spark):
    random.seed(8)
    d = {(a, b): random.random() for a in range(10) for b in range(a + 1, 10)}
    df = spark.createDataFrame([(f"m{a}", f"m{b}", v) for (a, b), v in d.items()], "a string, b string, distance double")
    groups = [[i] for i in range(10)]
    mean = lambda x, y: sum(d[min(i, j), max(i, j)] for i in x for j in y) / (len(x) * len(y))
    while len(groups) > 1:
        v, x, y = min((mean(x, y), x, y) for i, x in enumerate(groups) for y in groups[:i])
        if v > 0.45:
            break
        groups = [g for g in groups if g not in (x, y)] + [x + y]
    found = {}
    for r in motifs.cluster_motifs(df, 0.45).collect():
        found.setdefault(r.cluster_id, set()).add(r.motif_id)
    assert sorted(map(sorted, found.values())) == sorted(sorted(f"m{i}" for i in g) for g in groups)


def test_annotations_of_hits(spark):
    seqs = spark.createDataFrame([("s", "c", 100, 200, "-")], "seq_id string, chrom string, lo int, hi int, strand string")
    hits = spark.createDataFrame([("s", "m", 5, "-", 10)], "seq_id string, motif string, site int, strand string, width int")
    r = motifs.hits_to_annotations(hits, seqs).first()
    assert (r.lo, r.hi, r.strand) == (185, 195, "+")
    assert motifs.scan_input(spark.createDataFrame([("A", "N"), ("C", None)], "seq string, masked_seq string")).collect()[1].seq == "C"


def test_kl_and_ic(spark):
    p = spark.createDataFrame([("m", 0, b, f) for b, f in zip("ACGT", (0.7, 0.1, 0.1, 0.1), strict=True)], "motif_id string, pos int, base string, freq double")
    q = p.withColumn("freq", F.lit(0.25))
    want = sum(f * math.log2(f / 0.25) for f in (0.7, 0.1, 0.1, 0.1))
    assert motifs.kl(p, q).first().kl == pytest.approx(want)
    assert motifs.ic_matrix(p).filter("base = 'A'").first().value == pytest.approx(0.7 * want)


def test_synteny(spark):
    regions = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c"), ("r2", "d"), ("r3", "e")], "region_id string, gene_id string")
    orth = spark.createDataFrame([("b", "c")], "a string, b string")
    got = {r.id for r in graph.synteny_closure(spark.createDataFrame([("a",)], "id string"), regions, orth).collect()}
    assert got == {"a", "b", "c", "d"}


@pytest.mark.parametrize("per_salt", [1000, 7])
def test_kmer_hits_count_kmers_of_any_number_of_targets(spark, monkeypatch, per_salt):
    monkeypatch.setattr(joins, "KMER_TARGETS", per_salt)
    random.seed(5)
    bases = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    passage = bases(30)
    targets = [(f"t{i}", passage + bases(20)) for i in range(45)] + [(f"c{i}", passage) for i in range(45)] + [("short", "ACG"), ("other", bases(60))]
    queries = [("q1", passage), ("q2", bases(10) + passage[:20]), ("q3", bases(40))]
    sets_of = lambda rows: {i: {t[p : p + 8] for p in range(len(t) - 7)} for i, t in rows}
    x, y = sets_of(queries), sets_of(targets)
    want = {(q, t): (len(x[q] & y[t]), len(x[q] & y[t]) / min(len(x[q]), len(y[t]))) for q in x for t in y if len(x[q] & y[t]) >= 3}
    assert len(want) >= 180
    a, b = (spark.createDataFrame(r, "id string, seq string") for r in (queries, targets))
    got = {(r.query, r.target): (r.shared, pytest.approx(r.score)) for r in joins.kmer_hits(a, b, 8, 3).collect()}
    assert got == want


def test_a_walk_longer_than_any_limit(spark):
    """A chain of 60 hops settles, level by level."""
    n = 60
    regions = spark.createDataFrame([(f"r{i}", g) for i in range(n) for g in (f"a{i}", f"b{i}")], "region_id string, gene_id string")
    orth = spark.createDataFrame([(f"b{i}", f"a{i + 1}") for i in range(n - 1)], "a string, b string")
    got = {r.id: r.level for r in graph.synteny_closure(spark.createDataFrame([("a0",)], "id string"), regions, orth).collect()}
    assert got == {"a0": 0} | {f"a{i}": i for i in range(1, n)} | {f"b{i}": i + 1 for i in range(n)}


def test_candidate_network_follows_each_node_once(spark):
    hits = [("a", "b", 1.0), ("a", "c", 2.0), ("a", "d", 3.0), ("b", "a", 1.0), ("c", "e", 1.0), ("e", "f", 1.0)]
    df = spark.createDataFrame(hits, "query string, target string, significance double")
    seeds = spark.createDataFrame([("a",), ("a",), ("x",)], "id string")
    got = {depth: sorted(map(tuple, graph.candidate_network(seeds, df, 2, depth).collect())) for depth in (1, 2, 3)}
    assert got[1] == [("a", "b", 1), ("a", "c", 1)]
    assert got[2] == sorted(got[1] + [("b", "a", 2), ("c", "e", 2)]) and got[3] == sorted(got[2] + [("e", "f", 3)])


def test_random_intervals_against_counting(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    random.seed(12)
    seqs = [(f"c{i:02d}", "".join(random.choice("ACGTN") for _ in range(random.choice([0, 1, 16, 32, 47, 200])))) for i in range(20)]
    masked = [(c, x, None if c == "c03" else "".join("N" if random.random() < 0.2 else b for b in x)) for c, x in seqs]
    lengths = [(i, random.choice([1, 5, 16, 20])) for i in range(80)]
    import hashlib

    total, want = sum(len(x) for _, x in seqs), {}
    for i, n in lengths:
        for k in range(1, 7):
            at = int(hashlib.md5(f"3:{i}:{k}".encode()).hexdigest()[:12], 16) % total
            for c, x, m in masked:
                if at < len(x):
                    break
                at -= len(x)
            piece, hid = x[at : at + n], (m if m is not None else x)[at : at + n]
            if len(piece) == n and piece.count("N") <= 0.3 * n and 100 * (hid.count("N") - piece.count("N")) <= 15 * n:
                want[i] = (c, at, at + n)
                break
    df = spark.createDataFrame(masked, "id string, seq string, masked_seq string").repartition(3)
    ids = spark.createDataFrame(lengths, "id int, length int")
    got = topk.random_intervals(ids, df, 6, 0.3, 3, max_rep=15.0)
    assert {r.id: (r.chrom, r.lo, r.hi) for r in got.collect()} == want and 0 < len(want) < 80
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert topk.random_intervals(ids, df.limit(0), 6, 0.3, 3).count() == 0


def test_random_intervals_read_sequences_once(spark):
    made = spark.sparkContext.accumulator(0)

    def letters(batches):
        for b in batches:
            made.add(len(b))
            yield b

    seqs = spark.createDataFrame([(f"c{i}", "ACGTN" * (i * 300)) for i in range(8)], "id string, seq string").mapInPandas(letters, "id string, seq string")
    ids = spark.createDataFrame([(i, 20) for i in range(50)], "id int, length int")
    assert topk.random_intervals(ids, seqs.withColumn("masked_seq", F.replace("seq", F.lit("GTN"), F.lit("NNN"))), 4, 0.3, 3, max_rep=50.0).count() == 50
    assert made.value == 8


def test_random_intervals_write_no_letters(spark):
    rows = [(f"c{i}", 300_000) for i in range(4)]
    # Letters without repeats, which no codec brings below a quarter.
    letters = F.expr("array_join(transform(sequence(1, n div 32), i -> md5(concat(id, i))), '')")
    seqs = spark.createDataFrame(rows, "id string, n int").select("id", F.translate(letters, "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"))
    ids = spark.createDataFrame([(i, 20) for i in range(50)], "id int, length int")
    spark.range(1).checkpoint()
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    written = lambda: sum(f.stat().st_size for f in Path(top).rglob("part-*"))
    before = written()
    assert topk.random_intervals(ids, seqs, 4, 0.3, 3).count() == 50
    assert 0 < written() - before < sum(n for _, n in rows) / 5


def test_random_intervals_deal_out_draws(spark, monkeypatch):
    monkeypatch.setattr(topk, "DRAWS", 50)
    seqs = spark.createDataFrame([("a", "ACGT" * 500), ("b", "N" * 700), ("c", "A")], "id string, seq string")
    ids = spark.range(200).select("id", F.lit(10).alias("length")).coalesce(1)
    assert topk._draws(ids, 4, 3, 2701).rdd.getNumPartitions() == 16
    assert topk._draws(ids.limit(12), 4, 3, 2701).rdd.getNumPartitions() == 1
    got = {r.id: (r.chrom, r.lo, r.hi) for r in topk.random_intervals(ids, seqs, 4, 0.1, 3).collect()}
    monkeypatch.undo()
    assert got == {r.id: (r.chrom, r.lo, r.hi) for r in topk.random_intervals(ids, seqs, 4, 0.1, 3).collect()} and len(got) > 150


def test_hidden_tiles(spark):
    random.seed(13)
    rows = [(f"s{i}", "".join(random.choice("ACGTNn") for _ in range(random.choice([0, 1, 63, 64, 65, 100, 128, 300])))) for i in range(40)]
    # A masked text may be absent, shorter or longer; a sequence may be longer than a kernel's portion.
    rows = [(c, x, random.choice([None, "N" * 50, "NA" * 200, "T" * 99 + "N"])) for c, x in rows] + [("none", None, "N"), ("long", "ACGTN" * 500_000, "N" * 2_500_000)]
    df = spark.createDataFrame(rows, "id string, seq string, masked_seq string").repartition(3)
    for tile in (16, 64, 100, 1024):
        got = {}
        for r in sorted(kernels.hidden_tiles(df, ["seq", "masked_seq"], tile).collect(), key=lambda r: (r.id, r.t)):
            got.setdefault(r.id, []).append(r)
        assert set(got) == {c for c, x, _ in rows if x}
        for c, x, m in rows:
            for i, text in enumerate((x or "", ((m or "") + "A" * len(x or ""))[: len(x or "")])):
                tiles = got.get(c, [])
                assert [t.t for t in tiles] == list(range(-(-len(text) // tile))) and all(t["size"] == len(text) for t in tiles)
                n = 0
                for t in tiles:
                    piece = text[t.t * tile : (t.t + 1) * tile].upper()
                    words = [piece[j : j + 64] for j in range(0, len(piece), 64)]
                    assert [w % 2**64 for w in t[f"bits{i}"]] == [int(w[::-1].translate(str.maketrans("NACGT", "10000")), 2) for w in words]
                    for w, b in zip(words, t[f"before{i}"], strict=True):
                        assert b == n
                        n += w.count("N")


def _plain_distance(x, y):
    pad, tiny = [0.32, 0.18, 0.18, 0.32], 1e-9
    best = math.inf
    for s_ in range(1 - len(y), len(x)):
        cost = 0.0
        for i in range(min(0, s_), max(len(x), len(y) + s_)):
            p = x[i] if 0 <= i < len(x) else pad
            q = y[i - s_] if 0 <= i - s_ < len(y) else pad
            for a, b in zip(p, q, strict=True):
                a, b = a if a > 0 else tiny, b if b > 0 else tiny
                cost += (a - b) * (math.log2(a) - math.log2(b)) / 2
        best = min(best, cost)
    return best


@pytest.mark.parametrize("grid", [128, 3])
def test_motif_distances_against_loops(spark, monkeypatch, grid):
    monkeypatch.setattr(motifs, "GRID", grid)
    r = random.Random(grid)
    table = {}
    for k in range(8):
        rows = []
        for _ in range(r.choice([1, 4, 7])):
            w = [r.choice([0, r.random()]) for _ in range(3)] + [0.2]
            rows.append([v / sum(w) for v in w])
        table[f"m{k}"] = rows
    df = spark.createDataFrame([(m, i, b, row[j]) for m, rows in table.items() for i, row in enumerate(rows) for j, b in enumerate("ACGT")], "motif_id string, pos int, base string, freq double")
    for turned in (False, True):
        got = {(x.a, x.b): x.distance for x in motifs.motif_distances(df, turned).collect()}
        assert len(got) == 28
        for (a, b), d in got.items():
            want = _plain_distance(table[a], table[b])
            if turned:
                want = min(want, _plain_distance(table[a], [row[::-1] for row in table[b][::-1]]))
            assert a < b and d == pytest.approx(want, abs=1e-9)


def test_the_clusters_query_is_plain_average_linkage(spark):
    from regseq.plans import sequence_queries as sq

    d = "/root/testdata/sf0.001"
    dist = {frozenset((x.a, x.b)): x.distance for x in motifs.motif_distances(sq._freq(spark, d)).collect()}
    groups = [{m} for m in {m for pair in dist for m in pair}]
    mean = lambda g, h: sum(dist[frozenset((a, b))] for a in g for b in h) / (len(g) * len(h))
    while len(groups) > 1:
        best, i, j = min((mean(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if best > 0.35:
            break
        groups[i] |= groups.pop(j)
    got = {x.motif_id: x.cluster_id for x in sq.clusters(spark, d).collect()}
    assert got == {m: min(g) for g in groups for m in g}


def test_kmers_with_other_letters_meet_plain_ones(spark):
    """The table of bits knows a k-mer by itself, whatever letters stand around it in its portion."""
    passage = "ACGTNACGTTGACCA"
    a = spark.createDataFrame([("q", passage), ("r", "xx" + passage + "*")], "id string, seq string").coalesce(1)
    b = spark.createDataFrame([("t", "GG" + passage), ("u", "~~" + passage + "b"), ("v", "ACGTNA")], "id string, seq string")
    for k in (5, 8, 14):
        want = {(q, t): len({x[i : i + k] for i in range(len(x) - k + 1)} & {y[i : i + k] for i in range(len(y) - k + 1)}) for q, x in a.collect() for t, y in b.collect()}
        got = {(x.query, x.target): x.shared for left in (a, a.filter("id = 'q'"), a.filter("id = 'r'")) for right in (b, b.filter("id = 't'"), b.filter("id = 'u'")) for x in joins.kmer_hits(left, right, k, 1).collect()}
        assert got == {p: n for p, n in want.items() if n}


def test_homology_pairs_are_not_shuffled(spark, monkeypatch):
    """Genes that share several families, and families of more orthologs than one salt takes, give each pair once."""
    monkeypatch.setattr(joins, "FAMILY", 2)
    random.seed(4)
    rows = [(random.randrange(6), f"g{random.randrange(9)}", sp) for sp in ("own", "other A", "other B") for _ in range(40)] + [(None, "g1", "own"), (None, "g2", "other A"), (7, "h1", "own")]
    want = {(g, o, sp) for f, g, own in rows for f2, o, sp in rows if own == "own" and sp == "other A" and f is not None and f == f2 and g != o}
    found = joins.orthologs_from_homology(spark.createDataFrame(rows, "homology_id int, gene_id string, species string"), "own", "A$")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[: plan.index("Aggregate")]


def test_add_orthologs_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    pairs = spark.createDataFrame([("a", "x", "s"), ("b", "x", "s"), ("b", "y", "t"), ("c", "x", "s")], "gene_id string, ortholog string, ortholog_species string")
    edges = spark.createDataFrame([("a", "x", True), ("a", "x", True), ("b", "x", False), ("q", "r", True)], "src string, dst string, bidir boolean")
    for had in (edges, edges.filter("not bidir")):
        plain, once = (graph.add_orthologs(nodes, had, pairs, ["s"], once=o) for o in (False, True))
        for p, o in zip(plain, once, strict=True):
            assert sorted(map(tuple, o.collect())) == sorted(map(tuple, p.collect()))


def test_elements_meet_cut_sequences(spark, monkeypatch):
    """No more of a sequence goes to elements than they reach, with the same ratios and bases."""
    elements = spark.createDataFrame([("a", 1, 4), ("a", 6, 9), ("b", 0, 2)], "gene_id string, start int, end int")
    seqs = spark.createDataFrame([("a", "ACGTACGT", "ACNTACNN"), ("b", "ACGTACGTAAAAAAAA", "NCGTACGTAAAAAAAA"), ("c", "ACGT", "ACGT")], "gene_id string, seq string, masked_seq string")
    near = conservation._reached(elements, seqs, ["gene_id"], ["seq", "masked_seq"])
    assert sorted((r.gene_id, r.seq, r.masked_seq) for r in near.collect()) == [("a", "ACGTACGT", "ACNTACNN"), ("b", "ACGTACGTAA", "NCGTACGTAA")]
    for most in (10, 0):
        monkeypatch.setattr(conservation, "BROADCAST_ROWS", most)
        got = {(r.gene_id, r.start): r.repeat_ratio for r in conservation.element_repeat_ratio(elements, seqs).collect()}
        assert got == {("a", 1): 25.0, ("a", 6): 100.0, ("b", 0): pytest.approx(100 / 3)}
        where = seqs.select("gene_id", F.lit("z").alias("chrom"), F.lit(5).alias("lo"), (5 + F.length("seq")).alias("hi"), F.lit("-").alias("strand"), "seq")
        assert {(r.gene_id, r.start, r.seq, r.lo, r.hi) for r in conservation.bundles_to_modules(elements, where).collect()} == {("a", 1, "CGTA", 8, 12), ("a", 6, "GT", 3, 7), ("b", 0, "ACG", 18, 21)}
