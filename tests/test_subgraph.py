"""The neighbourhood of a topic holds everything that touches its entities."""

import __spark_entry__ as entry
from palaver.plans import queries


def test_no_entity_of_the_topic_is_cut_off(spark, sf_dir):
    run = entry.queries()
    got = {r.stable_key: r.type for r in run["graph_subgraph_nodes"](spark, sf_dir).collect()}
    risks = run["entities_extract"](spark, sf_dir).where("kind = 'risks'").select("meeting_id", "source_chunk_id").collect()
    assert sum(t == "Risk" for t in got.values()) == len(risks) and 3 * len(risks) > 40
    assert {k for k, t in got.items() if t == "Chunk"} == {f"chunk:{r.source_chunk_id}" for r in risks}
    assert {k for k, t in got.items() if t == "Meeting"} == {f"meeting:{r.meeting_id}" for r in risks}
    assert "LIMIT" not in queries.ORACLES["graph_subgraph_nodes"]
    assert run["graph_subgraph_edges"](spark, sf_dir).count() == 40  # its SQL has the limit
