"""A batch of messages: validation report, and migration with its report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from fieldlens.operators import flatten as fl, mapping as mp, validate as vd
from fieldlens.session import checkpoint


def validate_batch(messages: DataFrame, doc_id: str = "msg_id", xml: str = "xml", first: int = 5) -> dict[str, DataFrame]:
    """Issues, per-message summary, batch totals and error digest; messages are parsed once."""
    issues = checkpoint(vd.validate(messages, doc_id, xml))
    results = vd.results(messages, issues, doc_id)
    return {"Summary": vd.batch_report(results), "Results": results, "Issues": issues, "Messages": vd.summarise(issues, doc_id),
            "Digest": vd.error_digest(issues, first, doc_id)}


def migrate_batch(messages: DataFrame, source: DataFrame, target: DataFrame, custom: DataFrame | None = None, add_defaults: bool = True,
                  now: datetime | None = None, doc_id: str = "msg_id", xml: str = "xml") -> dict[str, DataFrame]:
    """Migrated messages with actions and statistics. ``target`` needs path, seq and min_occurs."""
    nodes, parse_issues = fl.parse_guard(fl.flatten_xml(messages, doc_id, xml, columns=fl.LEAF_COLUMNS), doc_id)
    values = checkpoint(fl.leaf_map(nodes, doc_id))
    mapping = checkpoint(mp.build_mapping(source, target, custom))
    migrated = checkpoint(mp.migrate(values, mapping, target, add_defaults, now, doc_id))
    actions = mp.actions(migrated, mp.unmapped_sources(values, mapping, target, doc_id), doc_id)
    return {"Messages": mp.rebuilt_messages(migrated, target, doc_id), "Actions": actions, "Statistics": mp.transform_stats(actions, doc_id),
            "Mapping": mapping, "Not Parsed": parse_issues}
