"""Every operator by its own name."""

from clinloom.functions.aggregates import fill_with_last, first_mode, get_valid, indicate_duplicates, na_max, na_min, sample_values
from clinloom.functions.choice import answer_check, calculate_index, combine_multichoice, na2false, split_multichoice
from clinloom.functions.dates import to_date
from clinloom.functions.names import EMP_COLORS, add_lists, common_prefix, merge_ordered_vectors, name2code, vec2code
from clinloom.functions.numbers import as_numeric, extract_num, extract_num_column, format_pval
from clinloom.functions.text import char_initial_cleaning, keep_by_keyword, replace_elements, str_match_replace, value_initial_cleaning
from clinloom.operators.baseline import baseline_table
from clinloom.operators.classification import classif_model_compare, importance_plot
from clinloom.operators.cut import cut_by
from clinloom.operators.encoding import auto_encoding_repair
from clinloom.operators.models import fit_cox, fit_logistic, fit_model, fit_ols
from clinloom.operators.normality import get_var_types, qq_show, test_normality
from clinloom.operators.outliers import detect_outliers, flag_outliers, iqr_outlier, mad_outlier, zscore_outlier
from clinloom.operators.overview import data_overview
from clinloom.operators.quality import check_nonnum, df_view_nonnum, exclusion_count, filter_rcs_predictors, max_missing_rates
from clinloom.operators.range_join import merge_by_range
from clinloom.operators.regression import ModelSpec, break_at, formula_add_covs, interaction_p_value, interaction_plot, interaction_scan, predictor_effect_plot, rcs_plot, regression_basic_results, regression_fit, regression_forest, regression_scan, subgroup_forest
from clinloom.operators.scan import last_valid
from clinloom.operators.screen_text import parse_rule
from clinloom.operators.screening import agg_, all_, any_, row_, screen_data_list, sql_
from clinloom.operators.subset import get_valid_subset
from clinloom.operators.substring_join import merge_by_substring, unmake_names
from clinloom.operators.survival import calc_cindex, concordance, km_curve, logrank, time_roc
from clinloom.operators.units import UnitRule, rules_from_table, unit_standardize
from clinloom.operators.views import subject_view, to_wide, unit_view
from clinloom.sources.files import combine_files, combine_frames, write_table

time_roc_plot = time_roc
get_samples = sample_values
__all__ = [n for n in dir() if not n.startswith("_")]
