"""Counts: quality control, normalisation, merging. Relations are long: sample, cell, gene, value; an absent row is 0."""

from __future__ import annotations

from homolith.functions.sqlop import Op

#: The limits of the quality filter.
MIN_FEATURES, MAX_FEATURES, MAX_MITO, MIN_RIBO, MIN_GENE_CELLS, MIN_CELLS = 500, 9000, 20, 5, 3, 250
#: The patterns of mitochondrial, ribosomal and haemoglobin genes (the last without a look-ahead, which is the same language).
MITO, RIBO, HAEM = "^MT-", "^RP[SL]", "^HB([^P]|$)"

COUNTS = Op("counts", """
SELECT n.n_name AS sample, r.r_name AS tissue, CASE WHEN n.n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS approach, o.o_orderkey AS cell,
  CASE p.p_partkey % 7 WHEN 0 THEN 'MT-' WHEN 1 THEN 'RPS' WHEN 2 THEN 'RPL' WHEN 3 THEN 'HBA' WHEN 4 THEN 'HBP' ELSE '' END || p.p_brand AS gene,
  CAST(sum(l.l_quantity) AS DOUBLE) AS value
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2, 3, 4, 5""")


def feature_pct(counts: Op, name: str = "qc_feature_pct") -> Op:
    """Share of each gene set in a cell's counts, in percent, and its number of genes."""
    share = lambda p: f"round(coalesce(sum(CASE WHEN #matches[[gene @@ '{p}']] THEN value END), 0) / nullif(sum(value), 0) * 100, 6)"
    return Op(name, f"SELECT sample, cell, count(CASE WHEN value > 0 THEN 1 END) AS n_feature, {share(MITO)} AS percent_mito, {share(RIBO)} AS percent_ribo, {share(HAEM)} AS percent_hb FROM {{counts}} GROUP BY sample, cell", counts=counts)


def cells(pct: Op, low=MIN_FEATURES, high=MAX_FEATURES, mito=MAX_MITO, ribo=MIN_RIBO, name="qc_cells") -> Op:
    """Cells within the limits; the ribosomal one is strict."""
    return Op(name, f"SELECT sample, cell, n_feature, percent_mito, percent_ribo FROM {{pct}} WHERE n_feature BETWEEN {low} AND {high} AND percent_mito <= {mito} AND percent_ribo > {ribo}", pct=pct)


def genes(counts: Op, kept: Op, more_than=MIN_GENE_CELLS, name="qc_genes") -> Op:
    """Genes with a count in more than so many of a sample's kept cells."""
    return Op(name, f"SELECT c.sample, c.gene, count(*) AS n_cells FROM {{counts}} c JOIN {{kept}} k ON c.sample = k.sample AND c.cell = k.cell WHERE c.value > 0 GROUP BY c.sample, c.gene HAVING count(*) > {more_than}", counts=counts, kept=kept)


def samples(kept: Op, least=MIN_CELLS, name="qc_samples") -> Op:
    return Op(name, f"SELECT sample, count(*) AS n_cells FROM {{kept}} GROUP BY sample HAVING count(*) >= {least}", kept=kept)


def lognorm(counts: Op, name="lognorm") -> Op:
    """ln(1 + 10,000 value / cell total)."""
    return Op(name, "SELECT sample, cell, gene, round(ln(1e0 + 1e4 * value / sum(value) OVER (PARTITION BY sample, cell)), 6) AS value FROM {counts}", counts=counts)


#: Sums of a gene in a sample and the number of the sample's cells: an absent row is 0 and counts.
MOMENTS = """n AS (SELECT sample, count(DISTINCT cell) AS n, sum(value) AS total FROM {counts} GROUP BY sample),
q AS (SELECT c.sample, c.gene, n.n, n.total, sum(c.value) AS s, sum(c.value * c.value) AS ss FROM {counts} c JOIN n ON n.sample = c.sample GROUP BY c.sample, c.gene, n.n, n.total),
g AS (SELECT sample, gene, n, total, s, s / n AS mean, CASE WHEN n > 1 THEN greatest(0e0, (ss - s * s / n) / (n - 1)) END AS var FROM q)"""


def residuals(counts: Op, theta: float = 100.0, name="pearson_residuals") -> Op:
    """Analytic Pearson residuals of negative-binomial counts, cut at the root of the number of cells: an analogue of
    regularised regression. Rows are the counts there are; absent ones would have their own residual."""
    return Op(name, f"""
WITH {MOMENTS}, t AS (SELECT sample, cell, sum(value) AS tc FROM {{counts}} GROUP BY sample, cell),
m AS (SELECT c.sample, c.cell, c.gene, c.value, t.tc * g.s / g.total AS mu, sqrt(g.n) AS top FROM {{counts}} c JOIN t ON t.sample = c.sample AND t.cell = c.cell JOIN g ON g.sample = c.sample AND g.gene = c.gene)
SELECT sample, cell, gene, round(greatest(-top, least(top, (value - mu) / sqrt(mu + mu * mu / {theta:e}))), 6) AS value FROM m""", counts=counts)


def variable(counts: Op, top: int = 10, name="variable_features") -> Op:
    """The genes of largest variance in each sample, over all of its cells."""
    return Op(name, f"WITH {MOMENTS} SELECT sample, gene, v, rk FROM (SELECT sample, gene, round(var, 6) AS v, row_number() OVER (PARTITION BY sample ORDER BY round(var, 6) DESC, gene) AS rk FROM g WHERE var IS NOT NULL) b WHERE rk <= {top}", counts=counts)


def scaled(counts: Op, zeros: bool = False, name="scale_data") -> Op:
    """z-scores by sample and gene over all cells; without spread 0. With `zeros` also of cells that lack the gene."""
    z = "round(coalesce(({v} - g.mean) / nullif(sqrt(g.var), 0), 0e0), 6) AS value"
    rows = f"SELECT c.sample, c.cell, c.gene, {z.format(v='c.value')} FROM {{counts}} c JOIN g ON g.sample = c.sample AND g.gene = c.gene"
    if zeros:
        rows = f"SELECT e.sample, e.cell, g.gene, {z.format(v='coalesce(c.value, 0e0)')} FROM (SELECT DISTINCT sample, cell FROM {{counts}}) e JOIN g ON g.sample = e.sample LEFT JOIN {{counts}} c ON c.sample = e.sample AND c.cell = e.cell AND c.gene = g.gene"
    return Op(name, f"WITH {MOMENTS} {rows}", counts=counts)


def centred(counts: Op, name="batch_centring") -> Op:
    """Each gene's mean in a sample brought to its mean over the cells of all samples: a plain analogue of batch correction. A row for each
    cell and each gene of any sample, as an absent count is moved too."""
    return Op(name, f"""
WITH {MOMENTS}, a AS (SELECT sum(n) AS cells FROM n), o AS (SELECT gene, sum(s) / max(a.cells) AS mean FROM g CROSS JOIN a WHERE gene IS NOT NULL GROUP BY gene),
m AS (SELECT n.sample, o.gene, coalesce(g.mean, 0e0) AS own, o.mean AS overall FROM n CROSS JOIN o LEFT JOIN g ON g.sample = n.sample AND g.gene = o.gene),
e AS (SELECT sample, cell, #entries[[gene @@ value]] AS held FROM {{counts}} GROUP BY sample, cell)
SELECT /*+ BROADCAST(m) */ e.sample, e.cell, m.gene, round(CASE WHEN #has[[e.held @@ m.gene]] THEN #get[[e.held @@ m.gene]] ELSE 0e0 END - m.own + m.overall, 6) + 0e0 AS value FROM e JOIN m ON m.sample = e.sample""", counts=counts)


def constant_metadata(counts: Op, name="constant_metadata") -> Op:
    """Metadata columns with one value in a sample, and its number of cells."""
    return Op(name, "SELECT sample, CASE WHEN count(DISTINCT tissue) = 1 THEN min(tissue) END AS tissue, CASE WHEN count(DISTINCT approach) = 1 THEN min(approach) END AS approach, count(DISTINCT cell) AS n_cells FROM {counts} GROUP BY sample", counts=counts)


def zero_filled(counts: Op, name="zero_filled_union") -> Op:
    """Sums by sample and gene over the union of all genes, 0 where a sample lacks one."""
    return Op(name, """
WITH g AS (SELECT DISTINCT gene FROM {counts}), s AS (SELECT DISTINCT sample FROM {counts}), v AS (SELECT sample, gene, sum(value) AS value FROM {counts} GROUP BY sample, gene)
SELECT s.sample, g.gene, coalesce(v.value, 0e0) AS value FROM s CROSS JOIN g LEFT JOIN v ON v.sample = s.sample AND v.gene = g.gene""", counts=counts)
