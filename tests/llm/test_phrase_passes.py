from scriptloom.llm import collocations as c


def test_texts_are_read_twice_at_any_size(spark, monkeypatch):
    """Frequent phrases of any number need no more scans of the texts: two jobs over them, and small tables flush in between."""
    monkeypatch.setattr(c, "AUTOMATON_BYTES", 64)
    monkeypatch.setattr(c, "RUN_BYTES", 50)
    monkeypatch.setattr(c, "BUCKET_PHRASES", 3)
    seen, before = [], c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, tag: seen.append(tag) or before(df, tag))
    rows = [(lang, f"w{k} x{k} y{k}") for k in range(40) for lang in ("a", "a\0", None) for _ in range(3)]
    words, counts = c.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 3, 3, slot_bits=16)
    got = {(r.lang, bytes(r.phrase).decode()): r.n for r in counts.collect()}
    assert got == {(lang or "und", p): 3 for lang, t in rows for w in [t.split()] for p in (" ".join(w[:2]), " ".join(w[1:]), t)}
    assert seen == ["sketch", "words", "phrases"] and words.count() == 360
