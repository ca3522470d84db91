"""Plan-shape guards: the properties the README claims, checked on the physical plans."""
import contextlib
import io
import re

from tagwarden.plans.queries import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
NARROW = ("tag_map_parse", "tag_map_rejects", "acl_normalize", "scopes_norm", "role_matrix", "log_parse",
          "retention", "auth_failures", "source_label", "outside_root")


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_plan_properties(spark, sf_dir):
    plans = {k: plan_text(fn(spark, sf_dir)) for k, fn in QUERIES.items()}
    for name, txt in plans.items():
        assert not [f for f in FORBIDDEN if f in txt], name
        widths = [s.count(":") for s in re.findall(r"ReadSchema: struct<([^>\n]*)>", txt)]
        assert max(widths, default=0) <= 6, (name, widths)  # column pruning reaches the scans
    for name in NARROW:  # per-row work: no shuffle exchange (broadcasts of small lookups are fine)
        assert not re.search(r"(?<![A-Za-z])Exchange", plans[name].split("\n\n")[0]), name
    # classification: one shuffle of the matched tags on the entity, whatever the size of the map
    for name in ("classify_status", "classify_wide"):
        assert len(re.findall(r"hashpartitioning\(entity_id", plans[name])) <= 2, name
    # top-N per key is limited on both sides of the exchange
    assert "WindowGroupLimit" in plans["tail_30"] and "Partial" in plans["tail_30"]
    # the diff kernel is one flag aggregation on the full key
    assert re.search(r"hashpartitioning\(scope#\d+, entity_id#\d+", plans["grant_diff"])
