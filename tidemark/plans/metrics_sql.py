"""DuckDB text shared by the metric queries."""

RUN = "dataset, repetition, model"


def score_ctes(src: str = "fx_scored", keys: str = RUN, name: str = "sc", where: str = "", score: str = "p") -> str:
    return f"""
{name}_n AS (SELECT {keys}, {score} AS p, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg FROM {src} {where} GROUP BY ALL),
{name} AS (SELECT *, CAST(sum(pos) OVER a AS BIGINT) AS cum_pos, CAST(sum(neg) OVER a AS BIGINT) AS cum_neg,
  CAST(sum(pos) OVER d AS BIGINT) AS tp_at, CAST(sum(neg) OVER d AS BIGINT) AS fp_at,
  CAST(sum(pos) OVER k AS BIGINT) AS tot_pos, CAST(sum(neg) OVER k AS BIGINT) AS tot_neg FROM {name}_n
  WINDOW a AS (PARTITION BY {keys} ORDER BY p), d AS (PARTITION BY {keys} ORDER BY p DESC), k AS (PARTITION BY {keys}))"""


AUC = "sum(pos * (cum_neg - neg + neg / 2.0)) / nullif(CAST(max(tot_pos) AS DOUBLE) * max(tot_neg), 0)"
PR = "sum(CAST(pos AS DOUBLE) / nullif(tot_pos, 0) * tp_at / (tp_at + fp_at))"


def conf_cte(src: str = "fx_scored", keys: str = RUN, name: str = "conf", thr: str = "0.5", where: str = "") -> str:
    return f"""
{name} AS (SELECT {keys}, count(*) FILTER (WHERE p >= {thr} AND label = 1) AS tp, count(*) FILTER (WHERE p >= {thr} AND label = 0) AS fp,
  count(*) FILTER (WHERE p < {thr} AND label = 1) AS fn, count(*) FILTER (WHERE p < {thr} AND label = 0) AS tn FROM {src} {where} GROUP BY ALL)"""


def safe(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


F1 = f"(({safe('2 * tp', '2 * tp + fp + fn')}) + ({safe('2 * tn', '2 * tn + fn + fp')})) / 2.0"
RATES = {
    "accuracy": safe("tp + tn", "tp + fp + fn + tn"),
    "balanced_accuracy": f"({safe('tp', 'tp + fn')} + {safe('tn', 'tn + fp')}) / 2.0",
    "precision": safe("tp", "tp + fp"),
    "recall": safe("tp", "tp + fn"),
    "macro_f1": F1,
    "fpr": "CAST(fp AS DOUBLE) / nullif(fp + tn, 0)",
}


def grid_ctes(src: str = "fx_scored", keys: str = RUN, name: str = "grid", where: str = "") -> str:
    """Best grid threshold by brute force: every threshold against the per-score counts."""
    cond = " AND ".join(f"s.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_s AS (SELECT {keys}, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {src} {where} GROUP BY ALL),
{name}_t AS (SELECT {keys}, k / 100.0E0 AS thr, sum(CASE WHEN p >= k / 100.0E0 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= k / 100.0E0 THEN neg ELSE 0 END) AS fp,
  sum(CASE WHEN p < k / 100.0E0 THEN pos ELSE 0 END) AS fn, sum(CASE WHEN p < k / 100.0E0 THEN neg ELSE 0 END) AS tn, k
  FROM {name}_s, range(5, 96) AS g(k) GROUP BY {keys}, k),
{name}_r AS (SELECT *, round({F1}, 12) AS macro_f1, row_number() OVER (PARTITION BY {keys} ORDER BY round({F1}, 12) DESC, abs(k - 50), k) AS rn FROM {name}_t),
{name} AS (SELECT {keys}, thr AS threshold, macro_f1 FROM {name}_r WHERE rn = 1)"""


def budget_ctes(src: str = "sc", keys: str = RUN, name: str = "bt", budgets=(0.01, 0.05, 0.1)) -> str:
    vals = ", ".join(f"({b}E0)" for b in budgets)
    return f"""
{name}_b AS (SELECT * FROM {src} CROSS JOIN (VALUES {vals}) AS b(budget)),
{name}_m AS (SELECT {keys}, budget, max(p) AS top, max(tot_pos) AS n_phishing, max(tot_neg) AS n_benign FROM {name}_b GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, budget ORDER BY tp_at DESC, p) AS rn FROM {name}_b WHERE CAST(fp_at AS DOUBLE) / tot_neg <= budget + 1e-15),
{name} AS (SELECT {', '.join('m.' + k.strip() for k in keys.split(','))}, m.budget, coalesce(r.p, m.top + 1.0) AS threshold, coalesce(r.tp_at, 0) AS tp, coalesce(r.fp_at, 0) AS fp, m.n_phishing, m.n_benign
  FROM {name}_m m LEFT JOIN (SELECT * FROM {name}_r WHERE rn = 1) r ON {' AND '.join(f'm.{k.strip()} = r.{k.strip()}' for k in keys.split(','))} AND m.budget = r.budget)"""
