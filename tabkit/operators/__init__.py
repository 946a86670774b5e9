from tabkit.operators.columns import (
    INT_AND_DOUBLE,
    NUMERIC_TYPES,
    cast_columns,
    columns_of_type,
    drop_columns,
    project,
)
from tabkit.operators.correlation import (
    corr_categorical,
    corr_long,
    corr_wide,
    cramers_v,
    pair_counts,
)
from tabkit.operators.filters import filter_in, filter_ne, filter_range
from tabkit.operators.forest import (
    Features,
    ForestParams,
    apply_features,
    assemble,
    assembly_report,
    deal,
    fit_features,
    importances,
    predict,
    skipped_rows,
    sweep,
    sweep_importances,
    sweep_models,
    train_forest,
)
from tabkit.operators.groups import (
    group_count,
    group_count_ranked,
    group_mean,
    group_mean_ratio,
    histogram,
    join_group_mean,
    row_count,
    time_bucket_count,
    top_k,
)
from tabkit.operators.indexing import (
    Labels,
    apply_labels,
    fit_labels,
    index_labels,
    label_counts,
    labels_of,
    rank_labels,
)
from tabkit.operators.lookup import join_lookup, measured_bytes
from tabkit.operators.metrics import classification_metrics, confusion_counts, metrics_row
from tabkit.operators.quality import (
    column_modes,
    drop_missing,
    drop_sparse,
    impute_modes,
    missing_counts,
    missing_profile,
    mode_row,
    narrowed,
    null_tokens,
    rows_before_after,
    settled_modes,
    sparse_columns,
)
from tabkit.operators.ranking import number_rows
from tabkit.operators.scaling import column_bounds, min_max, min_max_vector
from tabkit.operators.splitting import split_by_key, split_random, with_part
from tabkit.operators.trees import agreement, forest_nodes, forest_votes, node_importances
