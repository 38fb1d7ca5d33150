"""Fine-tuning corpora on Spark: validate, render, score, fingerprint, check."""

import sys

from pyspark import cloudpickle

from corpusgate.errors import CorpusError
from corpusgate.operators.budget import length_budget, over_budget, token_counter, tokenizer_file
from corpusgate.operators.checks import (
    check_columns,
    healthy,
    in_range,
    int_min,
    is_type,
    one_of,
    required,
    with_defaults,
)
from corpusgate.operators.classify import is_oom, with_exit_class, with_model_size, with_scope
from corpusgate.operators.completeness import members
from corpusgate.operators.detect import (
    detect_corpus_schema,
    schema_profile,
    with_detected_schema,
)
from corpusgate.operators.fingerprint import (
    corpus_digest,
    exact_duplicates,
    file_digests,
    line_digests,
    manifest,
    manifest_drift,
    run_groups,
    table_digest,
)
from corpusgate.operators.overlap import shared_inputs, without_shared
from corpusgate.operators.render import (
    CHATML,
    ChatTemplate,
    explode_messages,
    prompts,
    render_chat,
    render_task,
    render_turns,
)
from corpusgate.operators.reports import file_report
from corpusgate.operators.rules import (
    first_violation,
    require_valid,
    rule_counts,
    summarise,
    valid_records,
    validate,
)
from corpusgate.operators.score import (
    drop_echo,
    predict,
    score,
    score_by,
    score_predicted,
    score_total,
)
from corpusgate.operators.screen import policy_counts, redacted, screen
from corpusgate.operators.settings import check_settings
from corpusgate.sinks.files import write_chat_lines
from corpusgate.sources.lines import drop_blank, raw_lines, read_lines, read_records
from corpusgate.sources.records import read_runs, read_suite
from corpusgate.sources.turns import assemble_chat, chat_lines, reply_tasks

# Functions sent to Python workers travel by value, so the workers need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
