"""Small SQL text helpers for the DuckDB oracles (the Spark side never parses SQL)."""

from __future__ import annotations


def nan_div_sql(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 'NaN'::DOUBLE ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def zero_div_sql(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def metrics_sql(tp="tp", tn="tn", fp="fp", fn="fn", digits: int = 9) -> str:
    """Accuracy, Sensitivity, Specifisity, BA, Precision, F1 as SELECT items (rounded)."""
    tpr = nan_div_sql(tp, f"{tp} + {fn}")
    tnr = nan_div_sql(tn, f"{tn} + {fp}")
    prec = nan_div_sql(tp, f"{tp} + {fp}")
    items = {
        "Accuracy": nan_div_sql(f"{tp} + {tn}", f"{tp} + {fp} + {tn} + {fn}"),
        "Sensitivity": tpr,
        "Specifisity": tnr,
        "BA": f"(({tpr}) + ({tnr})) / 2",
        "Precision": prec,
        "F1": nan_div_sql(f"2 * ({tpr}) * ({prec})", f"({tpr}) + ({prec})"),
    }
    return ", ".join(f'{v} AS "{k}"' for k, v in items.items())


def class_state_sql(conf: str, keys: list[str], n_classes: int = 6) -> str:
    """(keys, class, tp, tn, fp, fn, support) from a (keys, label, prediction, n) relation."""
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    part = f"PARTITION BY {k}" if keys else ""
    return f"""
SELECT {kk}class, CAST(tp AS BIGINT) AS tp,
       CAST(sum(support) OVER ({part}) - support - (predicted - tp) AS BIGINT) AS tn,
       CAST(predicted - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn, CAST(support AS BIGINT) AS support
FROM (SELECT {kk}CAST(c.range AS INTEGER) AS class,
             sum(CASE WHEN label = c.range THEN n ELSE 0 END) AS support,
             sum(CASE WHEN prediction = c.range THEN n ELSE 0 END) AS predicted,
             sum(CASE WHEN label = c.range AND prediction = c.range THEN n ELSE 0 END) AS tp
      FROM {conf}, range({n_classes}) c
      GROUP BY {kk}c.range)
"""
