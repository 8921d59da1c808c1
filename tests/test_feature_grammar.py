"""Names read by hand, one for each form and each odd case."""

import pytest

from cytoloom.functions import feature_grammar as G

NN, CF, TR, AT = "NN", "cell_features", "triads", "athena"
CASES = [  # source, group, name -> kind, subtype, summary, compartment, [(role, cell, state)], status
    ("phenotype_only", NN, "cd8_t_cell_to_tumor_cell_Median", "nearest_neighbor", "1NN_distance", "Median", None, [("reference", "cd8_t_cell", None), ("neighbor", "tumor_cell", None)], "ok"),
    ("AR_state", NN, "cd8_t_cell__PD1_PDL1_to_nk__pd1_SD", "nearest_neighbor", "1NN_distance", "SD", None, [("reference", "cd8_t_cell", "PD1_PDL1"), ("neighbor", "nk_cell", "PD1")], "ok"),
    ("phenotype_only", NN, "a_to_b_to_c_Q1", "nearest_neighbor", "1NN_distance", "Q1", None, [("reference", None, None), ("neighbor", None, None)], "partial"),
    ("phenotype_only", NN, "cd8_to_nk_Range", None, None, None, None, [], "unparsed"),
    ("compartment_state", CF, "epi__DENSITY__t_cell_PD1_PDL1", "composition", "density", None, "Tumor", [("target", "t_cell", "PD1_PDL1")], "ok"),
    ("compartment_state", CF, "All__count__thing_PD1", "composition", "count", None, "All", [("target", None, "PD1")], "partial"),
    ("phenotype_only", CF, "Stroma__ratio__nk__over__treg__over__b", "composition", "ratio", None, "Stroma", [("numerator", "nk_cell", None), ("denominator", None, None)], "partial"),
    ("phenotype_only", CF, "All__ratio__nk", None, None, None, None, [], "unparsed"),
    ("phenotype_only", CF, "All__N_CELLS", "technical_qc", "n_cells", None, "All", [], "ok"),
    ("AR_checkpoint_state", CF, "All__prop__checkpoint neg", "composition", "proportion", None, "All", [("target", None, "checkpoint_neg")], "ok"),
    ("phenotype_only", TR, "triad_centered__nk__cd4__cd8__Stroma__count", "triad", "centered", "count", "Stroma", [("triad_1", "nk_cell", None), ("triad_2", "cd4_t_cell", None), ("triad_3", "cd8_t_cell", None)], "ok"),
    ("phenotype_only", TR, "triad_centered__nk__cd4__Stroma__count", None, None, None, None, [], "unparsed"),
    ("AR_checkpoint_state", TR, "triad__All__center__checkpoint_neg__n_cells", "triad", "legacy", "n_cells", "All", [("triad_state_or_target", None, "checkpoint_neg")], "ok"),
    ("phenotype_only", TR, "triad__All", "triad", "legacy", "All", "All", [], "ok"),
    ("phenotype_only", TR, "('nk', \"cd4\", 'x')Epi", "triad", "legacy_tuple", None, "Tumor", [("triad_1", "nk_cell", None), ("triad_2", "cd4_t_cell", None), ("triad_3", None, None)], "partial"),
    ("phenotype_only", TR, "n_cells_total_input", "technical_qc", "n_cells_total_input", None, None, [], "ok"),
    ("AR_state", AT, "inter_diff_cd8_t_cell__PD1__nk__checkpoint_neg__Epi", "ATHENA_interaction", "interaction_diff", None, "Tumor", [("source", "cd8_t_cell", "PD1"), ("target", "nk_cell", "checkpoint_neg")], "ok"),
    ("AR_state", AT, "inter_diff_cd8__nk__Epi", None, None, None, None, [], "unparsed"),
    ("phenotype_only", AT, "inter_p_cd8__nk__Epi", "ATHENA_interaction", "interaction_p", None, "Tumor", [("source", "cd8_t_cell", None), ("target", "nk_cell", None)], "ok"),
    ("phenotype_only", AT, "infiltration_nk__stroma__PCT_non_na", "ATHENA_infiltration", "infiltration", "pct_non_na", "Stroma", [("infiltrating", "nk_cell", None)], "ok"),
    ("phenotype_only", AT, "ripley_t_cell_border__All__at100", "ATHENA_spatial_statistics", "ripley", "at100", "All", [("target", "t_cell", None)], "ok"),
    ("phenotype_only", AT, "hill_type_q2_contact_knn__Tumor__min", "ATHENA_diversity", "hill", "min", "Tumor", [], "ok"),
    ("phenotype_only", AT, "hill_type_q1.2.3__Tumor__min", None, None, None, None, [], "unparsed"),
    ("phenotype_only", AT, "Rao_x__Tumor__max", "ATHENA_diversity", "rao", "max", "Tumor", [], "ok"),
    ("phenotype_only", CF, "All__count__PD1", "composition", "count", None, "All", [("target", None, "PD1")], "partial"),
    ("phenotype_only", "other", "All__count__nk", None, None, None, None, [], "unparsed"),
    ("phenotype_only", CF, None, None, None, None, None, [], "unparsed"),
]


@pytest.fixture(scope="module")
def read(spark):
    def run(rows):
        d = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], "i int, src string, grp string, name string, kind string")
        return [r.parsed for r in sorted(G.parse_features(d, "name", "src", "grp").collect(), key=lambda r: r.i)]

    return run


def test_forms(read):
    for case, r in zip(CASES, read([c[:3] for c in CASES]), strict=True):
        assert (r.kind, r.subtype, r.summary, r.compartment, [(e.role, e.cell, e.state) for e in r.entities], r.status) == case[3:], case
        assert (r.exact_key is None) == (r.status == "unparsed") and r.eligible == (r.kind != "technical_qc")


def test_parameters_and_lists(read):
    a, b, c, d = read([("phenotype_only", AT, "renyi_type_alpha0.50_radius__All__mean"), ("phenotype_only", AT, "ripley_nk_none_K__All__auc"), ("AR_checkpoint_state", TR, "triad__All__center__PD1__n_cells"), ("AR_state", CF, "All__ratio__cd8_PD1__over__cd4_PD1")])
    assert a.params == {"basis": "type_alpha0.50_radius", "alpha": "0.5", "graph": "radius"}
    assert b.params == {"edge_correction": "none", "ripley_variant": "K"}
    assert c.params == {"legacy_parts": '["center","PD1"]'}
    assert (d.cells, d.states, d.lineages, d.warnings) == (["cd8_t_cell", "cd4_t_cell"], ["PD1"], ["T_lineage"], [])


def test_missing_group_and_source(read):
    names = ["All__count__tumor", "All__count__nk", "PD1_to_pdl1_Mean", "Tumour__PD1_to_stroma__PD1_Mean", "nk__PD1_to_stroma__PD1_Mean", "odd", "inter_z_tumor__immune__All", "triad__All__center__PD1__n"]
    got = [(r.group, r.source, r.confidence, r.source_inferred) for r in read([(None, "", n) for n in names])]
    assert got == [(CF, "compartment", "medium", True), (CF, "phenotype_only", "low", True), (NN, "AR_checkpoint_state", "high", True), (NN, "compartment_state", "medium", True), (NN, "AR_state", "medium", True), (None, None, "none", True), (AT, "compartment", "medium", True), (TR, "AR_checkpoint_state", "high", True)]
    a, b, c = read([(None, None, "compartment|cell_features|All__count__tumor"), ("phenotype_only", None, "x|NN|nk_to_b_cell_SD"), ("phenotype_only", NN, "x|NN|nk_to_b_cell_SD")])
    assert (a.source, a.group, a.feature, a.source_inferred) == ("compartment", CF, "All__count__tumor", False)
    assert (b.source, b.group, b.status) == ("phenotype_only", NN, "ok") and c.status == "partial"


def test_keys(read):
    n = ["Epi__prop__t_cell_PD1", "epi__prop__tcell_pd1", "Epi__prop__t_cell_PDL1", "Stroma__prop__t_cell_PD1", "Epi__count__t_cell_PD1"]
    a, b, c, d, e = read([("AR_state", CF, x) for x in n])
    assert a.exact_key == b.exact_key and a.exact_key != c.exact_key
    assert a.state_key == c.state_key and a.state_key != d.state_key and a.compartment_key == d.compartment_key and len({x.compartment_key for x in (a, b, c, d, e)}) == 2
    f, g = read([("phenotype_only", NN, "nk_to_b_cell_SD"), ("phenotype_only", NN, "nk_to_b_cell_Mean")])
    assert f.metric_key == g.metric_key and f.state_key != g.state_key


def test_names_are_made_once_a_make(spark):
    from pyspark.sql import functions as F

    part = spark.range(40_000).selectExpr("id AS p_partkey", "CAST(id % 5 AS int) AS p_size")
    once = G.planted_once(part, F.count(F.lit(1)).alias("n"))
    by = lambda d, n, k: {(r.src, r.grp, r.name): (r.n, r.k) for r in d.groupBy("src", "grp", "name").agg(n.alias("n"), k.alias("k")).collect()}
    assert once.count() <= 360 * 5
    assert by(once, F.sum("n"), F.min("p_partkey")) == by(G.planted_names(part), F.count(F.lit(1)), F.min("p_partkey"))
