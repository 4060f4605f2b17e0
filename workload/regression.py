"""Least squares over folds and strata from one pass (R1, R2, R11, E12, E13), each next to its SQL twin."""

from pyspark.sql import functions as F

from staywise.operators import least_squares as ls
from staywise.operators import support_vectors as svr
from staywise.operators.metrics import regression_metrics
from workload.base import query, with_sales
from workload.modelling import LABEL, sales_parts
from workload.preparation import FEATURES, KEYS, PART_SQL, unit_sql

FOLDS = 3
STRATA = 4
DIMS = 64

#: Line items with label in thousands, part of the split and fold.
ROWS_SQL = (
    f"rows AS (SELECT {', '.join(FEATURES)}, l_extendedprice / 1000 AS price, p_type, {PART_SQL} AS part, "
    f"CAST(floor({unit_sql('fold', *KEYS)} * {FOLDS}) AS INTEGER) AS fold FROM sales)"
)


def line_sql(name: str, source: str, features, label: str, by: tuple[str, ...] = (), intercept: bool = True, ridge: float = 0.0) -> str:
    """CTEs that end in ``name`` (by..., b): intercept and coefficients by Gauss-Jordan elimination on lists."""
    keys = "".join(f"{c}, " for c in by)
    means = ", ".join(f"avg({f})" if intercept else "0.0" for f in features)
    cell = "covar_pop({0}, {1})" if intercept else "avg({0} * {1})"
    matrix = ", ".join(
        "[" + ", ".join([*[cell.format(f, g) + (f" + {ridge} / count(*)" if ridge and f == g else "") for g in features], cell.format(f, label)]) + "]"
        for f in features
    )
    mean_y = f"avg({label})" if intercept else "0.0"
    group = f" GROUP BY {', '.join(by)}" if by else ""
    p = len(features)
    return (
        f"{name}_m AS (SELECT {keys}[{means}] AS mx, {mean_y} AS my, [{matrix}] AS m FROM {source}{group}), "
        f"{name}_g AS (SELECT {keys}mx, my, m, 0 AS k FROM {name}_m UNION ALL "
        f"SELECT {keys}mx, my, list_transform(m, lambda r, i: list_transform(r, lambda v, j: "
        "CASE WHEN i = k + 1 THEN v / r[k + 1] ELSE v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)), k + 1 "
        f"FROM {name}_g WHERE k < {p}), "
        f"{name} AS (SELECT {keys}list_concat([my - list_sum(list_transform(m, lambda r, i: r[{p + 1}] * mx[i]))], "
        f"list_transform(m, lambda r: r[{p + 1}])) AS b FROM {name}_g WHERE k = {p})"
    )


def value_sql(features, b: str = "b") -> str:
    return " + ".join([f"{b}[1]", *[f"{b}[{i + 2}] * {f}" for i, f in enumerate(features)]])


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


METRICS_SQL = (
    "count(*) AS n_rows, round_even(sqrt(avg(e * e)), 4) AS rmse, round_even(avg(abs(e)), 4) AS mean_abs_error, "
    "round_even(1 - avg(e * e) / var_pop(price), 4) AS r2, round_even(median(abs(e)), 4) AS median_abs_error"
)


def _folds_sql() -> list[str]:
    """Training rows of every fold, the lines of both candidates, and the scores of the rows left out."""
    out = [
        ROWS_SQL,
        f"folds AS (SELECT unnest(range({FOLDS})) AS fold)",
        "out_of AS (SELECT folds.fold AS test, rows.* FROM rows JOIN folds ON rows.fold <> folds.fold WHERE part = 'train')",
    ]
    for name, intercept in (("with_b", True), ("without_b", False)):
        out.append(line_sql(name, "out_of", FEATURES, "price", ("test",), intercept))
    out.append(
        "lines AS (SELECT test, 1 AS intercept, b FROM with_b UNION ALL SELECT test, 0, b FROM without_b), "
        f"errors AS (SELECT intercept, fold, price, price - ({value_sql(FEATURES)}) AS e FROM rows JOIN lines ON test = fold WHERE part = 'train'), "
        "fold_r2 AS (SELECT intercept, fold, count(*) AS n_rows, 1 - avg(e * e) / var_pop(price) AS r2 FROM errors GROUP BY intercept, fold), "
        "means AS (SELECT intercept, avg(r2) AS mean_r2 FROM fold_r2 GROUP BY intercept), "
        "winner AS (SELECT intercept FROM means ORDER BY round(mean_r2, 9) DESC, intercept DESC LIMIT 1)"
    )
    return out


@query(
    recursive(
        with_sales(
            "SELECT fold, f.intercept, normalise, CAST(0 AS DOUBLE) AS ridge, n_rows, round_even(r2, 6) AS r2, round_even(mean_r2, 6) AS mean_r2, "
            "CASE WHEN f.intercept = winner.intercept AND normalise = 1 THEN 1 ELSE 0 END AS best "
            "FROM fold_r2 f JOIN means ON f.intercept = means.intercept, winner, (VALUES (0), (1)) v(normalise)",
            *_folds_sql(),
        )
    )
)
def grid_scores(t):
    """Every candidate's score on every fold."""
    train, _ = sales_parts(t, *KEYS)
    return _grid(train).frame(train)


def _grid(train):
    return ls.grid_least_squares(train, FEATURES, LABEL, ls.fold_of("fold", FOLDS, *KEYS))


@query(
    recursive(
        with_sales(
            f"SELECT {METRICS_SQL} FROM (SELECT price, price - ({value_sql(FEATURES)}) AS e FROM rows, "
            "(SELECT b FROM all_with WHERE (SELECT intercept FROM winner) = 1 UNION ALL SELECT b FROM all_without WHERE (SELECT intercept FROM winner) = 0) x "
            "WHERE part = 'test') q",
            *_folds_sql(),
            "train_rows AS (SELECT * FROM rows WHERE part = 'train')",
            line_sql("all_with", "train_rows", FEATURES, "price"),
            line_sql("all_without", "train_rows", FEATURES, "price", intercept=False),
        )
    )
)
def grid_linear(t):
    """Test metrics of the grid's winner (R2)."""
    train, test = sales_parts(t, *KEYS)
    line = _grid(train).line
    return regression_metrics(test.withColumn("prediction", line.column(FEATURES)), LABEL, "prediction")


#: The most frequent part types of the training rows; all others are the last stratum.
STRATA_SQL = (
    f"top AS (SELECT p_type AS s FROM rows WHERE part = 'train' AND p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT {STRATA}), "
    "split AS (SELECT rows.*, coalesce(s, 'other') AS stratum FROM rows LEFT JOIN top ON p_type = s), "
    "train_rows AS (SELECT * FROM split WHERE part = 'train')"
)


def strata_parts(t):
    """Training and test rows with their stratum; the strata come from the training rows."""
    train, test = sales_parts(t, *KEYS)
    names = ls.strata(train, "p_type", STRATA)
    return tuple(df.withColumn("stratum", ls.stratum("p_type", names)) for df in (train, test))


@query(
    recursive(
        with_sales(
            f"SELECT stratum, {METRICS_SQL} FROM (SELECT stratum, price, price - ({value_sql(FEATURES)}) AS e "
            "FROM split JOIN own USING (stratum) WHERE part = 'test') q GROUP BY stratum",
            ROWS_SQL,
            STRATA_SQL,
            line_sql("own", "train_rows", FEATURES, "price", ("stratum",)),
        )
    )
)
def strata_linear(t):
    """One line per stratum, fitted in one pass and scored in one."""
    train, test = strata_parts(t)
    lines, _, _ = ls.strata_lines(train, FEATURES, LABEL, "stratum")
    scored = ls.with_lines(test, "stratum", lines, FEATURES, "prediction")
    return regression_metrics(scored.filter("prediction is not null"), LABEL, "prediction", ["stratum"])


@query(
    recursive(
        with_sales(
            "SELECT model, stratum, count(*) AS n_rows, round_even(sqrt(avg(e * e)), 4) AS rmse, round_even(avg(abs(e)), 4) AS mean_abs_error, "
            "round_even(1 - avg(e * e) / var_pop(price), 4) AS r2 FROM ("
            "SELECT model, unnest([stratum, 'all']) AS stratum, price, price - p AS e FROM ("
            "SELECT stratum, price, unnest(['mean', 'one_line', 'line_per_stratum']) AS model, "
            f"unnest([m, {value_sql(FEATURES, 'whole.b')}, {value_sql(FEATURES, 'own.b')}]) AS p "
            "FROM split JOIN own USING (stratum), whole, (SELECT avg(price) AS m FROM train_rows) a WHERE part = 'test') x) y GROUP BY model, stratum",
            ROWS_SQL,
            STRATA_SQL,
            line_sql("own", "train_rows", FEATURES, "price", ("stratum",)),
            line_sql("whole", "train_rows", FEATURES, "price"),
        )
    )
)
def strata_scoreboard(t):
    """Test metrics of three models on every stratum and on all rows, from one pass over the test rows."""
    train, test = strata_parts(t)
    lines, whole, parts = ls.strata_lines(train, FEATURES, LABEL, "stratum")
    mean = float(ls.total(list(parts.values())).mean[-1])
    scored = ls.with_lines(test, "stratum", lines, FEATURES, "own")
    named = F.array(*[F.struct(F.lit(n).alias("model"), p.alias("prediction")) for n, p in (("mean", F.lit(mean)), ("one_line", whole.column(FEATURES)), ("line_per_stratum", F.col("own")))])
    rows = scored.select(LABEL, "stratum", F.explode(named).alias("m")).select(LABEL, "stratum", "m.*").filter("prediction is not null")
    both = rows.withColumn("stratum", F.explode(F.array("stratum", F.lit("all"))))
    return regression_metrics(both, LABEL, "prediction", ["model", "stratum"], median=False)


@query(
    recursive(
        "WITH vectors AS (SELECT label, "
        + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS d{i}" for i in range(DIMS))
        + " FROM embeddings), "
        + line_sql("fitted", "vectors", [f"d{i}" for i in range(DIMS)], "label", ridge=1.0)
        + f" SELECT unnest(['(intercept)', {', '.join(f'{chr(39)}d{i}{chr(39)}' for i in range(DIMS))}]) AS feature, "
        "unnest(list_transform(b, lambda v: round_even(v, 5))) AS coefficient FROM fitted"
    )
)
def fit_ridge_wide(t):
    """A penalised line over all components of the vectors (R1 with many features)."""
    names = [f"d{i}" for i in range(DIMS)]
    rows = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    line = ls.solve(ls.moments(rows, [*names, "label"])[()], ridge=1.0)
    out = [("(intercept)", line.intercept), *zip(names, line.coefficients)]
    return t.spark.createDataFrame(out, "feature string, coefficient double").withColumn("coefficient", F.bround("coefficient", 5))


def _machines(train):
    return svr.grid_svr(train, FEATURES, LABEL, ls.fold_of("fold", FOLDS, *KEYS), FOLDS, costs=(0.01, 1.0), gammas=(0.1,), size=20)


@query()
def svr_scores(t):
    """Support vector regression: every kernel's and cost's score on every fold."""
    train, _ = sales_parts(t, *KEYS)
    return _machines(train).frame(train)


@query()
def grid_svr(t):
    """Test metrics of the best support vector regression over kernel and cost."""
    train, test = sales_parts(t, *KEYS)
    predicted = test.select(LABEL, _machines(train).prediction.alias("prediction"))
    return regression_metrics(predicted, LABEL, "prediction")
