"""O128: feature names as structured records.

A name is read by the forms of its feature group; its entities are read by the rules of its source, since a token means a cell in one source, a
state in another and both in a third. Group and source are inferred where they are missing. All of it is native expressions over one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query

# Words for cells, their lineages, states and compartments, and the words in names.
CELLS = {
    "tumor": "tumor_cell", "tumour": "tumor_cell", "tumor_cell": "tumor_cell", "tumour_cell": "tumor_cell", "cancer": "tumor_cell", "cancer_cell": "tumor_cell", "panck": "tumor_cell",
    "stroma": "stromal_cell", "stromal": "stromal_cell", "stromal_cell": "stromal_cell", "all_neg": "stromal_cell", "fibro": "stromal_cell", "fibroblast": "stromal_cell",
    "immune": "immune_cell", "immune_cell": "immune_cell",
    "t_cell": "t_cell", "tcell": "t_cell", "cd8": "cd8_t_cell", "cd8_t_cell": "cd8_t_cell", "cd4": "cd4_t_cell", "cd4_t_cell": "cd4_t_cell", "treg": "treg_cell", "treg_cell": "treg_cell", "foxp3": "treg_cell",
    "b_cell": "b_cell", "bcell": "b_cell", "plasma": "plasma_cell", "plasma_cell": "plasma_cell", "nk": "nk_cell", "nk_cell": "nk_cell", "macrophage": "macrophage", "macrophages": "macrophage", "cd68": "macrophage",
}
LINEAGES = {"cd8_t_cell": "T_lineage", "cd4_t_cell": "T_lineage", "t_cell": "T_lineage", "treg_cell": "T_lineage", "b_cell": "B_lineage", "plasma_cell": "B_lineage", "nk_cell": "NK_lineage", "macrophage": "myeloid_lineage", "tumor_cell": "tumor", "stromal_cell": "stroma", "immune_cell": "immune"}
STATES = {"pd1": "PD1", "pdl1": "PDL1", "pd1_pdl1": "PD1_PDL1", "checkpoint_neg": "checkpoint_neg"}
COMPARTMENTS = {"all": "All", "tumor": "Tumor", "tumour": "Tumor", "epi": "Tumor", "stroma": "Stroma", "str": "Stroma"}
BROAD = ["immune_cell", "stromal_cell", "tumor_cell"]
DISTANCE_SUMMARIES = "Mean|SD|Max|Min|Median|Q1|Q3"
LOCAL_SUMMARIES = "min|mean|median|max|pct_non_na"
RIPLEY_SUMMARIES = r"at\d+|peak_abs|auc"
CORRECTIONS = "translation|border|ripley|none"
DIVERSITIES = "richness|shannon|simpson|renyi|hill|quadratic|rao|modularity"
PLACES = "All|Tumor|Stroma|Epi"
GRAPHS = ["radius", "contact", "knn"]
ATHENA_STARTS = r"^(inter|infiltration|ripley|richness|shannon|simpson|renyi|hill|quadratic|rao|modularity)_"
CELL_STATE_SOURCES, STATE_SOURCE = ["AR_state", "compartment_state"], "AR_checkpoint_state"

ENTITY = "array<struct<role:string,raw:string>>"


def _lookup(words: dict[str, str], token: Column) -> Column:
    """Canonical form of a token; null if there is none. Case, blanks and hyphens don't matter, nor do repeated underscores."""
    key = F.regexp_replace(F.lower(F.trim(token)), "[ _-]+", "_")
    return F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[key]


def cell(token: Column) -> Column:
    return _lookup(CELLS, token)


def state(token: Column) -> Column:
    return _lookup(STATES, token)


def compartment(token: Column) -> Column:
    return _lookup(COMPARTMENTS, token)


def entity(token: Column, role: Column, source: Column) -> Column:
    """(role, raw, cell, state, warning) of one entity: a state in a checkpoint source, a cell with a state behind one or two underscores in a source of both, else a cell. What doesn't fit is kept with a warning."""
    raw = F.trim(token)
    at_end = rf"(?is)^(.*?)_({'|'.join(sorted(STATES, key=len, reverse=True))})$"  # the longest state that the token ends with
    bits = F.split(raw, "__")
    two = (F.size(bits) == 2) & state(bits.getItem(1)).isNotNull()
    none = F.lit(None).cast("string")

    def found(c: Column, s: Column, warning: Column | str | None = None) -> Column:
        return F.struct(role.alias("role"), raw.alias("raw"), c.alias("cell"), s.alias("state"), (F.lit(warning) if not isinstance(warning, Column) else warning).cast("string").alias("warning"))

    def both(c: Column, s: Column) -> Column:
        return found(c, s, F.when(c.isNull(), "unparsed_cell_before_state"))

    c, s, lost = cell(raw), state(raw), found(none, none, "unparsed_entity")
    only_state = F.when(s.isNotNull(), found(none, s)).when(c.isNotNull(), found(c, none, "checkpoint_root_contains_cell_token")).otherwise(lost)
    cell_state = (
        F.when(two, both(cell(bits.getItem(0)), state(bits.getItem(1))))
        .when(raw.rlike(at_end), both(cell(F.regexp_extract(raw, at_end, 1)), state(F.regexp_extract(raw, at_end, 2))))
        .when(s.isNotNull(), found(none, s, "state_only_entity_in_cell_state_root"))
        .when(c.isNotNull(), found(c, none, "state_missing_in_state_root"))
        .otherwise(lost)
    )
    only_cell = F.when(c.isNotNull(), found(c, none)).when(s.isNotNull(), found(none, s, "state_token_in_nonstate_root")).otherwise(lost)
    return F.when(source == STATE_SOURCE, only_state).when(source.isin(CELL_STATE_SOURCES), cell_state).otherwise(only_cell)


def group_of(name: Column) -> Column:
    """The feature group that a name's form belongs to; null if none does."""
    return (
        F.when(name.contains("_to_") & name.rlike(f"_({DISTANCE_SUMMARIES})$"), "NN")
        .when(name.rlike(ATHENA_STARTS), "athena")
        .when(name.rlike("^(All|Epi|Stroma)__"), "cell_features")
        .when(name.rlike(r"^(triad_centered__|triad__|\()"), "triads")
    )


def source_of(name: Column, group: Column) -> Column:
    """(source, confidence) by the states and cells among a name's tokens."""
    stateful = name.rlike(rf"(?i)(^|_)({'|'.join(STATES)})($|_)")
    bare = name
    for s in sorted(STATES, key=len, reverse=True):
        bare = F.regexp_replace(bare, f"(?i){s}", "")
    cells = F.filter(F.transform(F.split(bare, "__|_to_"), lambda t: cell(F.regexp_replace(t, f"_({DISTANCE_SUMMARIES})$", ""))), lambda c: c.isNotNull())
    some, broad = F.size(cells) > 0, F.forall(cells, lambda c: c.isin(BROAD))
    pair = lambda a, b: F.struct(F.lit(a).cast("string").alias("source"), F.lit(b).alias("confidence"))
    return (
        F.when(stateful & ~some, pair(STATE_SOURCE, "high")).when(stateful & broad, pair("compartment_state", "medium")).when(stateful, pair("AR_state", "medium"))
        .when(some & broad, pair("compartment", "medium")).when(group.isNotNull(), pair("phenotype_only", "low")).otherwise(pair(None, "none"))
    )


def _form(kind: str, subtype: Column | str, summary: Column | None = None, place: Column | None = None, entities: Iterable[tuple[str, Column]] = (), params: Iterable[tuple[str, Column]] = (), eligible: bool = True) -> Column:
    """What a form says before its entities are read; parameters that are null are left out."""
    text = F.lit(None).cast("string")
    named = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in params)) if params else F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(
        F.lit(kind).alias("kind"), (F.lit(subtype) if isinstance(subtype, str) else subtype).alias("subtype"), (text if summary is None else summary).alias("summary"),
        (text if place is None else compartment(place)).alias("compartment"), F.array(*(F.struct(F.lit(r).alias("role"), t.alias("raw")) for r, t in entities)).cast(ENTITY).alias("entities"),
        F.map_from_entries(F.array_sort(F.filter(named, lambda p: p["value"].isNotNull()))).alias("params"), F.lit(eligible).alias("eligible"),
    )


def _distances(n: Column, source: Column) -> Column:
    p = f"^(.+)_to_(.+)_({DISTANCE_SUMMARIES})$"
    g = lambda i: F.regexp_extract(n, p, i)
    return F.when(n.rlike(p), _form("nearest_neighbor", "1NN_distance", g(3), entities=[("reference", g(1)), ("neighbor", g(2))]))


def _composition(n: Column, source: Column) -> Column:
    support = "(?i)^(All|Epi|Stroma)__(n_cells|n_resolved_for_ratio)$"
    ratio, one = "^((?i:All|Epi|Stroma))__(?i:ratio)__(.*?)__over__(.*)$", "^((?i:All|Epi|Stroma))__((?i:count|density|prop))__(.+)$"
    g = lambda p, i: F.regexp_extract(n, p, i)
    measure = F.lower(g(one, 2))
    return (
        F.when(n.rlike(support), _form("technical_qc", F.lower(g(support, 2)), place=g(support, 1), eligible=False))
        .when(n.rlike(ratio), _form("composition", "ratio", place=g(ratio, 1), entities=[("numerator", g(ratio, 2)), ("denominator", g(ratio, 3))]))
        .when(n.rlike(one), _form("composition", F.when(measure == "prop", "proportion").otherwise(measure), place=g(one, 1), entities=[("target", g(one, 3))]))
    )


def _triads(n: Column, source: Column) -> Column:
    parts = F.split(n, "__")
    at = lambda i: parts.getItem(i)
    last, middle = F.element_at(parts, -1), F.to_json(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))))
    legacy = lambda entities: _form("triad", "legacy", last, at(1), entities, [("legacy_parts", middle)])
    quoted = r"""^\s*(\((?:\s*(?:'[^']*'|"[^"]*")\s*,?)*\s*\))([^)]*)$"""
    cells = F.regexp_extract_all(F.regexp_extract(n, quoted, 1), F.lit(r"""(['"])(.*?)\1"""), F.lit(2))
    of_tuple = _form("triad", "legacy_tuple", place=F.regexp_extract(n, quoted, 2)).withField("entities", F.transform(cells, lambda t, i: F.struct(F.concat(F.lit("triad_"), (i + 1).cast("string")).alias("role"), t.alias("raw"))))
    return (
        F.when(n.rlike("^n_cells(_[A-Za-z0-9]+)*$"), _form("technical_qc", F.lower(n), eligible=False))
        .when(n.startswith("triad_centered__"), F.when(F.size(parts) == 6, _form("triad", "centered", at(5), at(4), [(f"triad_{i}", at(i)) for i in (1, 2, 3)])))
        .when(n.startswith("triad__"), F.when(F.size(parts) >= 4, legacy([("triad_state_or_target", F.get(parts, F.lit(3)))])).otherwise(legacy([])))
        .when(n.rlike(quoted), of_tuple)
    )


def _interactions(n: Column, source: Column) -> Column:
    flavour, rest = F.regexp_extract(n, "^inter_(diff|z|p)_", 1), F.split(F.regexp_extract(n, "^inter_(diff|z|p)_(.+)$", 2), "__")
    stateful = source.isin(CELL_STATE_SOURCES)
    at = lambda i: F.get(rest, F.lit(i))
    form = lambda a, b, place: _form("ATHENA_interaction", F.concat(F.lit("interaction_"), flavour), place=place, entities=[("source", a), ("target", b)], params=[("interaction_component", flavour)])
    return F.when(stateful & (F.size(rest) == 5), form(F.concat_ws("_", at(0), at(1)), F.concat_ws("_", at(2), at(3)), at(4))).when(~F.coalesce(stateful, F.lit(False)) & (F.size(rest) == 3), form(at(0), at(1), at(2)))


def _measures(n: Column, source: Column) -> Column:
    """Infiltration, Ripley's function, diversity and graph measures."""
    inside = f"(?i)^infiltration_(.+?)__({PLACES})__({LOCAL_SUMMARIES})$"
    ripley, corrected = f"(?i)^ripley_(.+?)__({PLACES})__({RIPLEY_SUMMARIES})$", f"(?i)^(.+?)_({CORRECTIONS})(?:_(.+))?$"
    local = f"(?i)^({DIVERSITIES})_(.+?)__({PLACES})__({LOCAL_SUMMARIES})$"
    g = lambda p, i, of=n: F.regexp_extract(of, p, i)
    body, basis, metric = g(ripley, 1), g(local, 2), F.lower(g(local, 1))
    some = lambda c: F.nullif(c, F.lit(""))
    number = {k: some(g(rf"(?i)(?:^|_){k}([0-9.]+)(?:_|$)", 1, basis)) for k in ("q", "alpha")}
    graph = F.lit(None).cast("string")
    for x in GRAPHS:  # the last that is named
        graph = F.when(basis.rlike(f"(?i)(?:^|_){x}(?:_|$)"), x).otherwise(graph)
    params = [("basis", basis), *((k, v.try_cast("double")) for k, v in number.items()), ("graph", graph)]
    odd = lambda v: v.isNotNull() & v.try_cast("double").isNull()
    target = F.when(body.rlike(corrected), g(corrected, 1, body)).otherwise(body)
    return (
        F.when(n.startswith("infiltration_"), F.when(n.rlike(inside), _form("ATHENA_infiltration", "infiltration", F.lower(g(inside, 3)), g(inside, 2), [("infiltrating", g(inside, 1))])))
        .when(n.startswith("ripley_"), F.when(n.rlike(ripley), _form("ATHENA_spatial_statistics", "ripley", F.lower(g(ripley, 3)), g(ripley, 2), [("target", target)], [("edge_correction", some(g(corrected, 2, body))), ("ripley_variant", some(g(corrected, 3, body)))])))
        .when(n.rlike(local) & ~odd(number["q"]) & ~odd(number["alpha"]), _form("ATHENA_diversity", metric, F.lower(g(local, 4)), g(local, 3), params=params).withField("kind", F.when(metric == "modularity", "ATHENA_graph").otherwise("ATHENA_diversity")))
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once: the optimizer doesn't copy it into each place that reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _distinct(rows: Column, field: str) -> Column:
    return F.array_distinct(F.filter(F.transform(rows, lambda e: e[field]), lambda x: x.isNotNull()))


def _record(n: Column, source: Column, group: Column, form: Column, entities: Column, inferred: Column, confidence: Column) -> Column:
    lost = form.isNull()
    warnings = F.when(~lost, _distinct(entities, "warning")).otherwise(F.array(F.when(group.isin("NN", "cell_features", "triads", "athena"), "grammar_mismatch").otherwise("unknown_group")))
    cells = _distinct(entities, "cell")
    lineages = F.array_distinct(F.filter(F.transform(cells, lambda c: F.create_map(*(F.lit(x) for kv in LINEAGES.items() for x in kv))[c]), lambda x: x.isNotNull()))

    def key(roles: list[str], *more: str) -> Column:
        return F.when(~lost, F.to_json(F.struct(form["kind"].alias("kind"), form["subtype"].alias("subtype"), F.transform(entities, lambda e: F.struct(*(e[r].alias(r) for r in roles))).alias("entities"), form["params"].alias("params"), *(form[m].alias(m) for m in more))))

    return F.struct(
        n.alias("feature"), source.alias("source"), group.alias("group"), inferred.alias("source_inferred"), confidence.alias("confidence"), *(form[f].alias(f) for f in ("kind", "subtype", "summary", "compartment")),
        entities.alias("entities"), F.coalesce(form["params"], F.create_map().cast("map<string,string>")).alias("params"), cells.alias("cells"), _distinct(entities, "state").alias("states"), lineages.alias("lineages"),
        F.coalesce(form["eligible"], F.lit(True)).alias("eligible"), F.when(lost, "unparsed").when(F.size(warnings) > 0, "partial").otherwise("ok").alias("status"), warnings.alias("warnings"),
        key(["role", "cell", "state"], "compartment", "summary").alias("exact_key"), key(["role", "cell"], "compartment", "summary").alias("state_key"), key(["role", "cell"], "compartment").alias("metric_key"), key(["role", "cell"], "summary").alias("compartment_key"),
    )


def parse(name: Column, source: Column | None = None, group: Column | None = None) -> Column:
    """The record of a feature name, as a struct.

    Fields: feature, source, group, source_inferred, confidence (of an inferred source), kind, subtype, summary, compartment, entities (role, raw,
    cell, state, warning), params, cells, states, lineages, eligible (false for bookkeeping columns), status (`ok`; `partial` with warnings;
    `unparsed` where no form of the group fits, with the other fields null or empty), warnings, and four keys: exact_key; state_key without
    states; metric_key without states and summary; compartment_key without states and compartment.

    A name `source|group|feature` gives what is not given. Missing sources and groups (null, empty, `nan`, `None`) are inferred from the name; a
    null name is unparsed.
    """
    missing = lambda c: c.isNull() | c.isin("", "nan", "None")
    none = F.lit(None).cast("string")
    name, source, group = name.cast("string"), none if source is None else source.cast("string"), none if group is None else group.cast("string")

    def read(x: Column) -> Column:
        n, packed = x["name"], x["name"].contains("|") & (x["source"].isNull() | x["group"].isNull()) & (F.size(x["bits"]) == 3)
        whole = F.struct(F.when(packed, F.get(x["bits"], F.lit(2))).otherwise(n).alias("n"), F.coalesce(x["source"], F.when(packed, F.get(x["bits"], F.lit(0)))).alias("s"), F.coalesce(x["group"], F.when(packed, F.get(x["bits"], F.lit(1)))).alias("g"))
        return _let(whole, lambda w: _let(F.when(missing(w["g"]), group_of(w["n"])).otherwise(w["g"]), lambda g: _let(F.when(missing(w["s"]), source_of(w["n"], g)), lambda guess: grouped(w["n"], w["s"], g, guess))))

    def grouped(n: Column, s: Column, g: Column, guess: Column) -> Column:
        return _let(F.when(missing(s), guess["source"]).otherwise(s), lambda src: _let(_forms(n, src, g), lambda form: _let(_entities_of(form, src), lambda es: _record(n, src, g, form, es, missing(s), guess["confidence"]))))

    return _let(F.struct(name.alias("name"), source.alias("source"), group.alias("group"), F.split(name, r"\|", 3).alias("bits")), read)


def _forms(n: Column, source: Column, group: Column) -> Column:
    """What the forms of the group say of a name; null if none fits."""
    athena = F.when(n.rlike("^inter_(diff|z|p)_"), _interactions(n, source)).otherwise(_measures(n, source))
    return F.when(group == "NN", _distances(n, source)).when(group == "cell_features", _composition(n, source)).when(group == "triads", _triads(n, source)).when(group == "athena", athena)


def _entities_of(form: Column, source: Column) -> Column:
    return F.coalesce(F.transform(form["entities"], lambda e: entity(e["raw"], e["role"], source)), F.array().cast("array<struct<role:string,raw:string,cell:string,state:string,warning:string>>"))


def parse_features(df: DataFrame, feature: str = "feature", source: str | None = None, group: str | None = None, out: str = "parsed") -> DataFrame:
    """Adds the records of a table's names (see parse) as a struct column; other columns stay as they are, but one called `out` is replaced."""
    return df.withColumn(out, parse(F.col(feature), *(F.col(c) if c else None for c in (source, group))))


#: Tokens that the test names are made of, and what they mean.
_TOKENS = ["Tumour", "PanCK", "fibro", "T cell", "CD8", "cd4-t_cell", "Treg", "bcell", "plasma", "nk", "Macrophages", "immune"]
_STATES = ["PD1", "pdl1", "PD1_PDL1", "checkpoint_neg"]
#: Names of every form: source and group (null: to be inferred) and the name, where {a} and {b} are cells, {s} and {u} states and {p} a compartment.
_NAMES = [
    ("phenotype_only", "NN", "{a}_to_{b}_Mean"), ("AR_state", "NN", "{a}__{s}_to_{b}__{u}_Q3"), ("AR_checkpoint_state", "NN", "{s}_to_{u}_SD"),
    ("compartment", "cell_features", "{p}__prop__{a}"), ("AR_state", "cell_features", "{p}__density__{a}_{s}"), ("phenotype_only", "cell_features", "{p}__ratio__{a}__over__{b}"), ("phenotype_only", "cell_features", "{p}__n_cells"),
    ("phenotype_only", "triads", "triad_centered__{a}__{b}__nk__{p}__frac_center"), ("compartment_state", "triads", "triad_centered__{a}_{s}__{b}_{u}__nk_PD1__{p}__count"), ("AR_checkpoint_state", "triads", "triad__{p}__center__{s}__n_cells"), ("phenotype_only", "triads", "('{a}', '{b}') {p}"), ("phenotype_only", "triads", "n_cells_total_input"),
    ("phenotype_only", "athena", "inter_z_{a}__{b}__{p}"), ("AR_state", "athena", "inter_diff_{a}__{s}__{b}__{u}__{p}"), ("AR_checkpoint_state", "athena", "inter_p_{s}__{u}__{p}"), ("phenotype_only", "athena", "infiltration_{a}__{p}__mean"),
    ("compartment", "athena", "ripley_{a}_translation_L__{p}__at40"), ("phenotype_only", "athena", "ripley_{a}__{p}__AUC"), ("phenotype_only", "athena", "renyi_type_alpha2_radius__{p}__median"), ("phenotype_only", "athena", "modularity_knn_q0.50__{p}__max"),
    (None, None, "compartment|cell_features|{p}__count__{a}"), (None, None, "{a}_to_{b}_Min"), (None, None, "{p}__prop__cd8__{s}"), ("phenotype_only", None, "odd {a}"), ("phenotype_only", "cell_features", "All__count__{s}"), ("AR_state", "cell_features", "All__count__{a}"),
    ("AR_checkpoint_state", "cell_features", "All__prop__{a}"), ("AR_state", "athena", "inter_z_{a}__{b}__{p}"), ("phenotype_only", "NN", "{a}_over_{b}"), ("nan", "", "infiltration_{a}__{p}__pct_non_na"),
]


def planted_names(part: DataFrame, *more: str) -> DataFrame:
    """(p_partkey, src, grp, name, more): a name for each part, of the form that its key picks."""
    n, key, size = len(_NAMES), F.col("p_partkey"), F.col("p_size")
    pick = lambda words, i: F.array(*(F.lit(w) for w in words))[(i % len(words)).cast("int")]
    step = F.floor(key / n)
    df = part.select("p_partkey", "p_size", *more, *(pick([x[i] for x in _NAMES], key).alias(c) for i, c in enumerate(("src", "grp", "name"))))
    for slot, value in (("{a}", pick(_TOKENS, size)), ("{b}", pick(_TOKENS, step)), ("{s}", pick(_STATES, size)), ("{u}", pick(_STATES, step)), ("{p}", pick(["All", "Epi", "Stroma"], step))):
        df = df.withColumn("name", F.replace("name", F.lit(slot), value))
    return df.select("p_partkey", "src", "grp", "name", *more)


def planted_once(part: DataFrame, *what: Column) -> DataFrame:
    """(p_partkey, src, grp, name) and aggregates over the parts that have the name, one row for the parts of like make (some 18,000 whatever the table's size; p_partkey is the least), so that no name is made or parsed for each part."""
    alike = part.groupBy(F.pmod("p_partkey", F.lit(len(_NAMES) * len(_TOKENS))).alias("_turn"), "p_size").agg(F.min("p_partkey").alias("p_partkey"), *what)
    return planted_names(alike, *alike.columns[3:])


def _list(words: Iterable[str | None]) -> str:
    return "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words) + "]"


def _case(values: list[str]) -> str:
    """SQL that picks a value by the form k."""
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _said() -> str:
    """CTEs with what each planted name means, said from what it was made of rather than by reading it."""
    cell_of = [CELLS[t.lower().replace(" ", "_").replace("-", "_")] for t in _TOKENS]
    e = lambda role, c="'-'", s="'-'": f"'{role}=' || {c} || '/' || {s}"
    both = lambda r, q: f"{e(r, 'a', 's')} || ';' || {e(q, 'b', 'u')}"
    cells = lambda r, q: f"{e(r, 'a')} || ';' || {e(q, 'b')}"
    states = lambda r, q: f"{e(r, s='s')} || ';' || {e(q, s='u')}"
    nothing = "''"
    forms = [  # kind, subtype, summary, entities, params
        ("nearest_neighbor", "1NN_distance", "'Mean'", cells("reference", "neighbor"), nothing), ("nearest_neighbor", "1NN_distance", "'Q3'", both("reference", "neighbor"), nothing), ("nearest_neighbor", "1NN_distance", "'SD'", states("reference", "neighbor"), nothing),
        ("composition", "proportion", None, e("target", "a"), nothing), ("composition", "density", None, e("target", "a", "s"), nothing), ("composition", "ratio", None, cells("numerator", "denominator"), nothing), ("technical_qc", "n_cells", None, nothing, nothing),
        ("triad", "centered", "'frac_center'", cells("triad_1", "triad_2") + " || ';triad_3=nk_cell/-'", nothing), ("triad", "centered", "'count'", both("triad_1", "triad_2") + " || ';triad_3=nk_cell/PD1'", nothing), ("triad", "legacy", "'n_cells'", e("triad_state_or_target", s="s"), """'legacy_parts=["center","' || rs || '"]'"""), ("triad", "legacy_tuple", None, cells("triad_1", "triad_2"), nothing), ("technical_qc", "n_cells_total_input", None, nothing, nothing),
        ("ATHENA_interaction", "interaction_z", None, cells("source", "target"), "'interaction_component=z'"), ("ATHENA_interaction", "interaction_diff", None, both("source", "target"), "'interaction_component=diff'"), ("ATHENA_interaction", "interaction_p", None, states("source", "target"), "'interaction_component=p'"), ("ATHENA_infiltration", "infiltration", "'mean'", e("infiltrating", "a"), nothing),
        ("ATHENA_spatial_statistics", "ripley", "'at40'", e("target", "a"), "'edge_correction=translation;ripley_variant=L'"), ("ATHENA_spatial_statistics", "ripley", "'auc'", e("target", "a"), nothing), ("ATHENA_diversity", "renyi", "'median'", nothing, "'alpha=2.0;basis=type_alpha2_radius;graph=radius'"), ("ATHENA_graph", "modularity", "'max'", nothing, "'basis=knn_q0.50;graph=knn;q=0.5'"),
        ("composition", "count", None, e("target", "a"), nothing), ("nearest_neighbor", "1NN_distance", "'Min'", cells("reference", "neighbor"), nothing), ("composition", "proportion", None, e("target", "'cd8_t_cell'", "s"), nothing), None, ("composition", "count", None, e("target", s="s"), nothing), ("composition", "count", None, e("target", "a"), nothing),
        ("composition", "proportion", None, e("target", "a"), nothing), None, None, ("ATHENA_infiltration", "infiltration", "'pct_non_na'", e("infiltrating", "a"), nothing),
    ]
    at = lambda i: _case(["NULL" if f is None or f[i] is None else f"'{f[i]}'" if i < 2 else f[i] for f in forms])
    broad = lambda c: f"{c} IN {tuple(BROAD)}"
    source = {20: "'compartment'", 21: f"CASE WHEN {broad('a')} AND {broad('b')} THEN 'compartment' ELSE 'phenotype_only' END", 22: "'AR_state'", 29: "CASE p WHEN 'Stroma' THEN 'compartment' ELSE 'phenotype_only' END"}
    src = _case([source.get(i, "NULL" if x[0] is None else f"'{x[0]}'") for i, x in enumerate(_NAMES)])
    group = {20: "'cell_features'", 21: "'NN'", 22: "'cell_features'", 29: "'athena'"}
    grp = _case([group.get(i, "NULL" if x[1] is None else f"'{x[1]}'") for i, x in enumerate(_NAMES)])
    warned = {23: "unknown_group", 24: "state_token_in_nonstate_root", 25: "state_missing_in_state_root", 26: "checkpoint_root_contains_cell_token", 27: "grammar_mismatch", 28: "grammar_mismatch"}
    warnings = _case([f"'{warned[i]}'" if i in warned else "''" for i in range(len(_NAMES))])
    no_place = (0, 1, 2, 11, 21, 23, 27, 28)
    place = _case(["NULL" if i in no_place else "'All'" if i in (24, 25, 26) else "CASE p WHEN 'Epi' THEN 'Tumor' ELSE p END" for i in range(len(_NAMES))])
    status = f"CASE WHEN k IN (23, 27, 28) THEN 'unparsed' WHEN k IN ({', '.join(map(str, warned))}) THEN 'partial' ELSE 'ok' END"
    return f"""
WITH made AS (
    SELECT p_partkey, p_partkey % {len(_NAMES)} AS k, {_list(cell_of)}[p_size % 12 + 1] AS a, {_list(cell_of)}[(p_partkey // {len(_NAMES)}) % 12 + 1] AS b, {_list(STATES[x.lower()] for x in _STATES)}[p_size % 4 + 1] AS s,
        {_list(_STATES)}[p_size % 4 + 1] AS rs, {_list(STATES[x.lower()] for x in _STATES)}[(p_partkey // {len(_NAMES)}) % 4 + 1] AS u, ['All', 'Epi', 'Stroma'][(p_partkey // {len(_NAMES)}) % 3 + 1] AS p FROM part
), said AS MATERIALIZED (
    SELECT p_partkey, k, {src} AS source, {grp} AS grp, {at(0)} AS kind, {at(1)} AS subtype, {at(2)} AS summary, {place} AS compartment, coalesce({at(3)}, '') AS entities, coalesce({at(4)}, '') AS params, {warnings} AS warnings, {status} AS status FROM made
)"""


def _oracle() -> str:
    pairs = "list_filter(list_transform(string_split(entities, ';'), lambda x: string_split(x, '=')[2]), lambda x: x IS NOT NULL)"
    part = lambda i: f"list_filter(list_transform({pairs}, lambda x: string_split(x, '/')[{i}]), lambda x: x <> '-')"
    first = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
    lines = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LINEAGES.items()) + "}"
    return f"""{_said()}, split AS MATERIALIZED (
    SELECT *, {first(part(1))} AS cells, {first(part(2))} AS states FROM said
)
SELECT p_partkey, source, grp, k IN (21, 22, 29) AS source_inferred, kind, subtype, summary, compartment, entities, params, array_to_string(cells, ';') AS cells, array_to_string(states, ';') AS states,
    array_to_string({first(f"list_transform(cells, lambda c: {lines}[c])")}, ';') AS lineages, k NOT IN (6, 11) AS eligible, status, warnings FROM split"""


def _entities(parsed: Column) -> Column:
    return F.array_join(F.transform(parsed["entities"], lambda e: F.format_string("%s=%s/%s", e["role"], F.coalesce(e["cell"], F.lit("-")), F.coalesce(e["state"], F.lit("-")))), ";")


def _params(parsed: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(parsed["params"]), lambda m: F.concat_ws("=", m["key"], m["value"]))), ";")


@query("o128_feature_parser", _oracle())
def _o128(t):
    p = parse_features(planted_names(t("part")), "name", "src", "grp")
    o = lambda f: F.col(f"parsed.{f}")
    return p.select("p_partkey", o("source"), o("group").alias("grp"), o("source_inferred"), o("kind"), o("subtype"), o("summary"), o("compartment"), _entities(F.col("parsed")).alias("entities"), _params(F.col("parsed")).alias("params"), *(F.array_join(o(c), ";").alias(c) for c in ("cells", "states", "lineages")), o("eligible"), o("status"), F.array_join(o("warnings"), ";").alias("warnings"))


@query("o128_measure_names", f"{_said()} SELECT kind, subtype, entities, params, compartment, summary, count(*) AS names FROM said WHERE status <> 'unparsed' GROUP BY ALL")
def _o128_measures(t):
    """Names that mean the same, found by their key."""
    n = planted_once(t("part"), F.count(F.lit(1)).alias("names"))
    p = parse_features(n, "name", "src", "grp").where("parsed.exact_key IS NOT NULL")
    return p.groupBy("parsed.exact_key").agg(F.sum("names").alias("names"), F.first("parsed").alias("o")).select("o.kind", "o.subtype", _entities(F.col("o")).alias("entities"), _params(F.col("o")).alias("params"), "o.compartment", "o.summary", "names")
