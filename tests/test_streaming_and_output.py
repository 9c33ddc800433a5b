"""The drop folder as a stream, and what a cycle writes."""

import os

import pytest
from pyspark.sql import functions as F

from pricelode.operators import catalog, memory, output, verify
from pricelode.plans import cycle
from pricelode.streaming import intake


def test_files_are_processed_once(spark, tmp_path):
    folder, done = tmp_path / "in", f"file://{tmp_path}/done"
    folder.mkdir()
    (folder / "a.txt").write_text("Fideos $10")
    seen = []

    def handle(df, batch_id):
        seen.extend(r["text"] for r in df.collect())

    def run():
        intake.run_batches(intake.dropped_messages(spark, f"file://{folder}"), done, handle, f"file://{tmp_path}/cp").awaitTermination(60)

    run()
    (folder / "b.txt").write_text("fideos   $10")
    (folder / "c.txt").write_text("Pan $5")
    run()
    assert sorted(seen) == ["Fideos $10", "Pan $5"]


def test_copies_and_answers_as_state(spark, tmp_path):
    """Repeated, late and restarted batches: a copy is dropped across restarts, a decision finds a quote of an earlier batch."""
    quotes, decisions = tmp_path / "quotes", tmp_path / "decisions"
    quotes.mkdir(), decisions.mkdir()

    def stream(folder, schema):
        return spark.readStream.schema(schema).json(f"file://{folder}")

    def run():
        first = intake.first_copies(stream(quotes, "huella string, at timestamp, price double"), within="2 days")
        both = intake.answered(stream(quotes, "huella string, at timestamp, price double"), stream(decisions, "huella string, decided_at timestamp, action string"), "7 days", "2 days")
        for df, name in ((first, "first"), (both, "both")):
            out = df.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
            out.awaitTermination(120)
        return sorted((r["huella"], r["price"]) for r in spark.read.parquet(f"file://{tmp_path}/first").collect()), sorted((r["huella"], r["action"]) for r in spark.read.parquet(f"file://{tmp_path}/both").collect())

    (quotes / "1.json").write_text('{"huella": "a", "at": "2024-03-01 10:00:00", "price": 1}\n{"huella": "a", "at": "2024-03-01 11:00:00", "price": 1}')
    (decisions / "1.json").write_text('{"huella": "a", "decided_at": "2024-03-01 12:00:00", "action": "aprobar"}\n{"huella": "b", "decided_at": "2024-03-02 12:00:00", "action": "early"}')
    assert run() == ([("a", 1.0)], [("a", "aprobar"), ("a", "aprobar")])
    # after a restart: a late copy of a, a late quote that a decision waited for, and a decision after its time
    (quotes / "2.json").write_text('{"huella": "a", "at": "2024-02-29 20:00:00", "price": 2}\n{"huella": "b", "at": "2024-03-02 09:00:00", "price": 3}\n{"huella": "c", "at": "2024-03-01 09:00:00", "price": 4}')
    (decisions / "2.json").write_text('{"huella": "c", "decided_at": "2024-03-09 12:00:00", "action": "too late"}')
    first, both = run()
    assert first == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    assert ("b", "early") in both and ("c", "too late") not in both


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert intake.decisions_per_window(events).agg(F.sum("n")).first()[0] == events.count()


def test_output(spark, tmp_path):
    table = spark.createDataFrame([("x.a", "", "A", 1.5)], "id string, default_code string, name string, standard_price double")
    assert output.write_import(table, f"file://{tmp_path}/import") and not output.write_import(table.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(verify.ImportRefused):
        output.write_import(table.union(table), f"file://{tmp_path}/twice")
    got = spark.range(1).select(output.pesos(F.lit(1234.5)), output.pesos(F.lit(7.0)), output.pesos(F.lit(None).cast("double")), output.percent(F.lit(9.6)), output.percent(F.lit(-3.0))).first()
    assert list(got) == ["$ 1.234,50", "$ 7", "", "+10%", "-3%"]
    old = {"alias": spark.createDataFrame([("t", "r")], "texto string, referencia string")}
    output.save_memory(old, f"file://{tmp_path}/mem", 3)
    assert output.load_memory(spark, f"file://{tmp_path}/mem", 3, ["alias"])["alias"].first()["referencia"] == "r"
    for version in range(4, 8):
        output.save_memory(old, f"file://{tmp_path}/mem", version, keep=3)
    assert output.complete_versions(spark, f"file://{tmp_path}/mem")[0] == 7 and not (tmp_path / "mem/version=4").exists() and (tmp_path / "mem/version=5").exists()
    assert output.load_memory(spark, f"file://{tmp_path}/mem", names=["alias"])["alias"].count() == 1
    assert memory.empty(spark, "ajustes").columns == ["seq", "clave", "valor"]


def test_two_writers_of_one_version(spark, tmp_path):
    """The slower one's change is made again on what the faster one wrote; a version has one writer."""
    path, calls = f"file://{tmp_path}/mem", []

    def adding(word):
        new = spark.createDataFrame([(0, word, "r", "", "")], memory.schema_of("alias"))
        return lambda tables: tables | {"alias": memory.append(tables["alias"], new)}

    assert output.update_memory(spark, path, adding("a")) == 1

    def slower(tables):
        calls.append(tables)
        if len(calls) == 1:
            output.update_memory(spark, path, adding("b"))
        return adding("c")(tables)

    assert output.update_memory(spark, path, slower) == 3 and len(calls) == 2
    assert [r["texto"] for r in output.load_memory(spark, path)["alias"].orderBy("seq").collect()] == ["a", "b", "c"]
    with pytest.raises(output.ConflictError):
        output.save_memory({"alias": memory.empty(spark, "alias")}, path, 3)
    assert output.load_memory(spark, path, 3)["alias"].count() == 3
    # a claim of a writer that is gone
    (tmp_path / "mem/claims/4").touch()
    os.utime(tmp_path / "mem/claims/4", (0, 0))
    assert output.update_memory(spark, path, adding("d")) == 4


def test_continuation_over_ranges(spark):
    """Rows without a name continue the last named one, wherever the export was cut."""
    rows = [(i, "n" if i in (3, 4, 40, 77) else "") for i in range(90)]
    df = spark.createDataFrame(rows, "seq long, name string").repartition(7)
    got = {r["seq"]: r["grp"] for r in catalog.continued(df, F.col("name") != "", "seq", "grp").collect()}
    assert got == {i: max((k for k in (3, 4, 40, 77) if k <= i), default=None) for i in range(90)}
    assert catalog.continued(df.limit(0), F.col("name") != "", "seq", "grp").count() == 0


def test_source_ids_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(7, 3), ((1 << 32) - 1, 0)], "source_id long, line_no int")
    assert [r[0] for r in df.select(cycle.line_id(F.col("source_id"), F.col("line_no"))).collect()] == [(7 << 31) + 3, ((1 << 32) - 1) << 31]
    with pytest.raises(Exception, match="source id"):
        spark.createDataFrame([(1 << 32, 0)], "source_id long, line_no int").select(cycle.line_id(F.col("source_id"), F.col("line_no"))).collect()


def test_decisions_are_a_log(spark, tmp_path, monkeypatch):
    """A store read from its log, folded or not, stopped and opened again, equals one that upserts each decision into the table."""
    monkeypatch.setattr(cycle, "FOLD_AFTER", 3)
    rows = {n: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], memory.schema_of(n)) for n, x in {
        "alias": [("pan", "r0", "rio", ""), ("miel", "r1", "", "")], "codigos_proveedor": [("Río", "A-1", "d", "r1", "6"), ("Sur", "B2", "d", "r2", "")], "aprobados": [("r1", "gramaje", "")]}.items()}
    store = cycle.Store(spark, dict(rows), path=f"file://{tmp_path}/store")
    plain = dict(rows)
    code = lambda p, c, r, u="": {"proveedor": p, "codigo_proveedor": c, "referencia_odoo": r, "unidades": u}
    for name, new, keys, absent in [
        ("alias", {"texto": "pan", "referencia": "r5", "proveedor": "rio"}, ["texto", "proveedor"], False), ("alias", {"texto": "pan", "referencia": "r6", "proveedor": "rio"}, ["texto", "proveedor"], False),
        ("codigos_proveedor", code("rio", "a1", "r7"), ["x"], False), ("codigos_proveedor", code("RIO", "A 1", "r8", "12"), ["x"], False), ("codigos_proveedor", code("Rio", "A1", "r9"), ["x"], False),
        ("alias", {"texto": "te", "referencia": "r7", "proveedor": ""}, ["texto", "proveedor"], False), ("alias", {"texto": "te", "referencia": "r8", "proveedor": ""}, ["texto", "proveedor"], False),
        ("aprobados", {"referencia": "r1", "tipo": "gramaje", "motivo": "late"}, ["referencia", "tipo"], True), ("aprobados", {"referencia": "r2", "tipo": "gramaje", "motivo": "x"}, ["referencia", "tipo"], True),
        ("aprobados", {"referencia": "r2", "tipo": "gramaje", "motivo": "y"}, ["referencia", "tipo"], True), ("alias", {"texto": "added", "referencia": "r1"}, None, False), ("codigos_proveedor", code("sur", "b-2", "r3"), ["x"], False),
    ]:
        store.put(name, [new], keys, absent)
        one = spark.createDataFrame([(0, *(new.get(c, "") for c in memory.TABLES[name]))], memory.schema_of(name))
        how = memory.append if keys is None else memory.upsert_codes if name == "codigos_proveedor" else None
        plain[name] = spark.createDataFrame((how(plain[name], one) if how else (memory.insert_absent if absent else memory.upsert)(plain[name], one, keys)).collect(), memory.schema_of(name))
    told = lambda df: [tuple(r)[1:] for r in df.orderBy("seq").collect()]
    again = cycle.Store(spark, {"aprobados": rows["aprobados"], "codigos_proveedor": rows["codigos_proveedor"]}, path=f"file://{tmp_path}/store")
    for name in rows:
        assert told(store.read(name)) == told(plain[name]) == told(again.read(name)), name
    again.put("aprobados", [{"referencia": "r3", "tipo": "gramaje"}], ["referencia", "tipo"], True)
    assert again.read("aprobados").count() == 3
