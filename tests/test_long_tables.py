"""Long tables: their cells are dealt to tasks by rows."""

from pricelode.sources import cells


def book(spark, rows):
    """One book: a tab of lists with as many rows, one of messages."""
    tabs = [(1, 0, "a", 0, 0, "PROVEEDOR"), (1, 0, "a", 0, 1, "Nos envía"), (1, 1, "b", 0, 0, "Proveedor"), (1, 1, "b", 0, 1, "Mensaje")]
    said = [(1, tab, "ab"[tab], n, col, f"{'sx'[col]}{n}") for tab in (0, 1) for n in range(1, rows + 1) for col in (0, 1)]
    return spark.createDataFrame(tabs + said, "source_id long, tab_no int, tab string, row_no long, col int, value string")


def test_cells_are_no_small_side(spark, tmp_path):
    """However small Spark takes the file of the cells to be, they are never sent whole to the tasks, and a tab is not one task's."""
    book(spark, 30).write.parquet(f"file://{tmp_path}/book")
    seen = spark.read.parquet(f"file://{tmp_path}/book")
    plan = cells.book_rows(seen)._jdf.queryExecution().sparkPlan().toString()
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in first and "chunk" in first


def test_chunks_change_nothing(spark, monkeypatch):
    seen = book(spark, 7)
    lines = seen.filter("tab_no = 0").replace({"PROVEEDOR": "Código", "Nos envía": "Descripción"}).unionByName(
        spark.createDataFrame([(1, 0, "a", n, 2, "Precio" if n == 0 else f"{n},50") for n in range(8)], seen.schema)
    )
    both = lambda: ([sorted(map(tuple, f.collect())) for f in (cells.book_rows(seen), cells.table_lines(lines))])
    whole = both()
    monkeypatch.setattr(cells, "CHUNK", 2)
    assert both() == whole and [len(x) for x in whole] == [14, 7]
