"""The chain of document sources of a knowledge base, worked by hand."""

from botqa.operators import kb as KB

_DOCS = "kb string, doc_id string, content string, source string, section string, source_type string, is_synthetic boolean, doc_ord long"
_SETTINGS = "kb string, domain string, topics array<string>, synthetic_from_scratch boolean, enable_synthetic boolean"
_SCRATCH = "kb string, topic_no int, content string"
_VARIED = "kb string, doc_id string, challenge_type string, content string"


def _run(spark, docs, settings, scratch, varied):
    docs, settings = spark.createDataFrame(docs, _DOCS), spark.createDataFrame(settings, _SETTINGS)
    kb = KB.assemble(docs, settings, spark.createDataFrame(scratch, _SCRATCH), spark.createDataFrame(varied, _VARIED))
    status = {r["kb"]: tuple(r)[1:] for r in KB.kb_status(settings, kb).collect()}
    return {(r["kb"], r["doc_id"]): r for r in kb.collect()}, status


def test_chain(spark):
    docs = [("a", "1234567890", " text ", "up.txt", "One", "UPLOADED", False, 1), ("a", "2", None, "s", None, "UPLOADED", False, 2),
            ("b", "3", "made before", "m", "", "SYNTHETIC_CHALLENGING", True, 1)]
    settings = [("a", "legal", [], True, True), ("b", "Legal", None, True, True), ("c", "retail", ["x y", "z"], True, False),
                ("d", "retail", ["never asked"], False, True), ("e", "unknown", None, True, True)]
    scratch = [("a", 0, "not asked for"), ("b", 0, " terms "), ("b", 1, None), ("b", 7, "no such topic"),
               *[("c", i, f"c{i}") for i in range(3)], ("d", 0, "not asked for")]
    varied = [("a", "1234567890", "multi_section", "\n varied "), ("a", "2", "out_of_scope", "two"), ("a", "2", "jargon", "not asked for"),
              ("b", "synthetic_scratch_service_agreement_terms_0", "multi_section", "varied terms"), ("b", "3", "multi_section", "not asked for"),
              ("c", "synthetic_scratch_x_y_0", "multi_section", "switched off")]
    got, status = _run(spark, docs, settings, scratch, varied)
    assert sorted(got) == [
        ("a", "1234567890"), ("a", "2"), ("a", "synthetic_multi_section_1234567890"), ("a", "synthetic_out_of_scope_2"),
        ("b", "3"), ("b", "synthetic_multi_section_synthetic_scratch_service_agreement_terms_0"), ("b", "synthetic_scratch_service_agreement_terms_0"),
        ("c", "synthetic_scratch_x_y_0"), ("c", "synthetic_scratch_z_1")]
    x = got["a", "synthetic_multi_section_1234567890"]
    assert (x["content"], x["source"], x["section"], x["based_on"], x["is_synthetic"]) == ("varied", "synthetic_multi_section_12345678", "One [multi_section]", "up.txt", True)
    x = got["b", "synthetic_scratch_service_agreement_terms_0"]
    assert (x["content"], x["source"], x["section"], x["challenge_type"]) == ("terms", "synthetic_scratch_service_agreement_terms", "service agreement terms", "from_scratch")
    assert got["a", "1234567890"]["content"] == " text "
    # basis, documents, real, scratch, variations
    assert status == {"a": ("real", 4, 2, 0, 2), "b": ("scratch", 3, 0, 1, 1), "c": ("scratch", 2, 0, 2, 0), "d": ("none", 0, 0, 0, 0), "e": ("none", 0, 0, 0, 0)}


def test_limits_and_empty_tables(spark):
    docs = [("a", str(i), "t", "s", "", "UPLOADED", False, i) for i in range(12)]
    varied = [("a", str(i), c, "v") for i in range(12) for c in KB.CHALLENGE_TYPES]
    topics = [f"topic {i} {'long ' * 9}" for i in range(7)]
    got, status = _run(spark, docs, [("a", "legal", None, True, True), ("b", "legal", topics, True, False)],
                       [("b", i, "made") for i in range(7)], varied)
    assert status == {"a": ("real", 12 + KB.VARIATIONS_PER_DOC * KB.MAX_DOCS_PER_SOURCE, 12, 0, 20), "b": ("scratch", KB.MAX_SCRATCH_DOCS, 0, 5, 0)}
    assert all(len(r["source"]) <= len("synthetic_scratch_") + 30 for r in got.values() if r["kb"] == "b")
    assert _run(spark, [], [], [], []) == ({}, {})
