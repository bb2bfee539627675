"""Data contracts on Spark: check, gate, profile and compare tables by declared rules."""

from .operators.check import Report, assert_conforms, check, check_all
from .operators.consumers import annotate, scope, verify
from .operators.diff import diff
from .operators.drift import Thresholds, drift
from .operators.infer import infer
from .operators.profile import Profile, merge, profile
from .plans.spec import Contract, ContractError, load
from .streaming.gate import gate, judge, register_functions
from .streaming.records import RecordGate

__all__ = [
    "Contract", "ContractError", "Profile", "RecordGate", "Report", "Thresholds", "annotate", "assert_conforms", "check", "check_all", "diff", "drift",
    "gate", "infer", "judge", "load", "merge", "profile", "register_functions", "scope", "verify",
]
