"""Raw table to features and scaled label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from driftwalk.operators.cleaning import (
    LABEL,
    cast_to_double,
    drop_null_rows,
    require_rows,
    select_features,
)
from driftwalk.operators.labels import normalize_labels, trend_labels
from driftwalk.operators.ordering import (
    PART,
    PART_ROWS,
    ROW,
    compact_index,
    groups_are_bounded,
    index_rows,
    number_across_parts,
    number_in_parts,
)
from driftwalk.staging import stage


def prepare_features_and_labels(
    df: DataFrame,
    order: Sequence[str],
    series: Sequence[str] = (),
    price: str = "mid_price",
    features: Sequence[str] | None = None,
    filter_length: float = 10.0,
    shift_length: int = 10,
    num_std: float = 5.0,
    fit_rows: Column | None = None,
    null_subset: Sequence[str] | None = None,
    bounded: bool | None = None,
    part_rows: int = PART_ROWS,
    check_rows: bool = False,
) -> tuple[DataFrame, list[str], str]:
    """Cast, index, label, drop nulls, renumber and scale the label.

    Returns the table ``series, row_idx, features, label``, the feature names
    and the label name. ``row_idx`` counts the rows that are left. Short series
    stay on one partitioning throughout; with a long series the labelled rows
    are staged once, since the statistics, the renumbering and the rows
    themselves all read them.
    """
    series, order = list(series), list(order)
    reserved = [*series, *order]
    chosen = select_features(df.columns, price, features, [] if features else reserved)
    if bounded is None:
        bounded = groups_are_bounded(df, series)
    if LABEL in chosen:
        raise ValueError(f"feature named like the label: {LABEL}")
    # A feature may also be the price or an order column; casts work on copies.
    needed = list(dict.fromkeys([*series, *order, price, *chosen, *(null_subset or df.columns)]))
    rows = drop_null_rows(df.select(*needed), null_subset)
    rows = index_rows(rows, order, series, bounded=bounded)
    kept = list(dict.fromkeys([*series, ROW, price, *chosen]))
    rows = cast_to_double(rows.select(*kept), [c for c in [price, *chosen] if c not in series])
    rows = trend_labels(
        rows,
        price,
        filter_length,
        shift_length,
        series,
        part_rows=part_rows,
        keep_part=not bounded,
    )
    checked = None
    if null_subset is not None:
        made = ["filtered_price", "future_filtered_price", "l_value"]
        checked = [*made, *[c for c in null_subset if c in rows.columns]]
    rows = drop_null_rows(rows, checked)
    if bounded:
        rows = compact_index(rows, series, bounded=True)
    else:
        # Numbered on the layout the labels were computed on, then staged.
        kept = [*series, ROW, *chosen, "l_value", PART]
        numbered = number_in_parts(rows.select(*dict.fromkeys(kept)), series)
        rows = number_across_parts(stage(numbered, "labelled"), series)
    if check_rows:
        require_rows(rows)
    rows = normalize_labels(
        rows,
        series=series,
        num_std=num_std,
        fit_rows=fit_rows,
        bounded=bounded,
        part_rows=part_rows,
    )
    return rows.select(*series, ROW, *chosen, LABEL), chosen, LABEL
