

# The rules register themselves; a registry with some of them would give some of the findings.
from . import code_rules, flow_rules, shape_rules, syntax_rules  # noqa: F401
