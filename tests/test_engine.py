"""Functions, readers, memory and whole cycles on a small shop."""

import pytest
from pyspark.sql import functions as F

from pricelode import constants as K
from pricelode.functions import fuzzy, numbers, text
from pricelode.operators import catalog as C
from pricelode.operators import classify, memory, verify
from pricelode.plans import cycle
from pricelode.sources import cells, messages, office, pricelists, sheets

PRODUCTS = [
    ("PAN001", "Prepizza napolitana - Panadería Norte", 2000), ("PAN002", "Pan de campo 500 g - Panadería Norte", 3000), ("DUL001", "Prepizzas integrales x 2 - Dulces del Sur", 5500),
    ("PAS001", "Fideos naturales 500 g - Pastas Río", 3500), ("PAS002", "Fideos con miel 500 g - Pastas Río", 3700), ("PAS003", "Fideos con miel y cacao 500 g - Pastas Río", 3900),
    ("PAS004", "Canelones de verdura x 6 - Pastas Río", 9000), ("EMB001", "Bondiola feteada 150 g - Embutidos Sierra", 3200), ("EMB002", "Salame picado grueso 300 g - Embutidos Sierra", 5900),
    ("ESP001", "Orégano 50 g - Especias Luna", 600), ("ESP002", "Comino 25 g - Especias Luna", 640), ("LIM001", "Lavandina 1 l - Limpieza Clara", 850),
]
SUPPLIERS = ["Panadería Norte", "Dulces del Sur", "Pastas Río", "Embutidos Sierra", "Especias Luna", "Limpieza Clara"]


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(i, f"__export__.product_{i}", n, r, str(c), "True", "7") for i, (r, n, c) in enumerate(PRODUCTS)]
    raw = spark.createDataFrame(rows, "seq long, id string, name string, default_code string, standard_price string, is_published string, qty_available string")
    table = C.build_catalog(raw)
    return spark.createDataFrame(table.collect(), table.schema)


@pytest.fixture
def store(spark):
    s = cycle.Store(spark)
    s.put("impuestos", [{"ambito": "proveedor", "clave": p, "iva": "0.21", "percepcion": "0", "incluido": "si"} for p in SUPPLIERS])
    return s


def run(spark, shop, store, *texts, kind="texto", supplier="", **more):
    rows = [(i, kind, f"m{i}", supplier, t, i) for i, t in enumerate(texts)]
    return cycle.run_cycle(shop, store, spark.createDataFrame(rows, cycle.SOURCE), **more)


def test_plain_text():
    n = text.normalize_text
    assert "500g" in n("Ravioles x 1/2 kg") and n("750 g") == n("0,75 kg") == n("750g") == "750g"
    assert "12u" in n("huevos x 12") and "500g" in n("reggianito x 500")
    assert text.size_note("Orégano x 25 g", "Orégano 50 g").startswith("presentación distinta")
    assert text.corrected_size("Orégano x 25 g", "Orégano 50 g - Luna").startswith("Orégano 25 g")
    own = text.own_abbreviations([("bahi", "bahia"), ("zz", "")])
    assert text.expand_text("ATUN BAHI bahia zz", own).split() == ["atun", "bahia", "bahia"]
    assert fuzzy.token_sort(n("15 canelones"), n("canelones")) == pytest.approx(84.2, abs=0.1)
    assert fuzzy.token_set(n("Distribuidora Dos"), n("Distribuidora Uno")) == pytest.approx(88.2, abs=0.1)
    assert fuzzy.token_set("a b", "b c a") == 100 and fuzzy.indel("", "") == 100


def test_ratio_is_symmetric_and_exact():
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy.lcs(a, b) == slow(a, b) == fuzzy.lcs(b, a)


def test_column_numbers(spark):
    one = spark.range(1)
    get = lambda *c: one.select(*c).first()
    num = lambda t: numbers.export_number(F.lit(t))
    assert list(get(num("1.234,50"), num("1,234.5"), num("980,5"), num("$ 7"), num("x"))) == [1234.5, 1234.5, 980.5, 7.0, None]
    msg = lambda t: numbers.message_number(F.lit(t))
    assert list(get(msg("2.598"), msg("14.294,5"), msg("3,5"), msg("12.5"))) == [2598.0, 14294.5, 3.5, 12.5]
    lst = lambda t, d: numbers.list_number(F.lit(t), F.lit(d))
    assert list(get(lst("1397,88", "."), lst("1,808.13", "."), lst("2.598", ","), lst("2670.631", "."))) == [1397.88, 1808.13, 2598.0, 2670.631]
    cost = lambda mode, price, net: numbers.list_cost(F.lit(price), F.coalesce(numbers.option_rates(F.lit(mode))[0], F.lit(K.VAT)), numbers.option_rates(F.lit(mode))[2], numbers.option_rates(F.lit(mode))[3], F.lit(net))
    got = list(get(cost("incluido", 3630.0, False), cost("incluido", 3630.0, True), cost("21", 3000.0, False), cost("21", 3000.0, True), cost("21+3", 3000.0, False), cost("21+3", 3000.0, True)))
    assert got == pytest.approx([3630, 3000, 3630, 3000, 3738.9, 3000])
    day = lambda t: numbers.latest_date(F.lit(t), F.lit("2026-01-01").cast("date"))
    assert [str(x) for x in get(day("lista 31/2/25 y 3-4-25"), day("1/1/1999"), day("5/5/2999 1.2.2024"))] == ["2025-04-03", "None", "2024-02-01"]


def test_alert_cascade_is_the_last_writer(spark):
    """The CASE against writing the alerts one over another."""
    import itertools

    def last_writer(state, score, current, change, conflict, missing, other, ok_size, ok_change, ok_cycle):
        a = ""
        if state == "revisar":
            a = "match a confirmar"
        if score < 75:
            a = "match dudoso"
        if not current:
            a = "no tenía costo cargado"
        if change is not None and abs(change) > 30:
            a = "variación fuerte"
        if conflict and not ok_size:
            a = "presentación distinta"
        if ok_change:
            a = ""
        if ok_cycle and a in ("variación fuerte", "no tenía costo cargado"):
            a = ""
        if other and state != "sin cambio":
            a = "otra fuente"
        if missing and state == "ok":
            a = "falta IVA"
        if state == "sin match":
            a = "sin match"
        return a

    no_yes = (False, True)
    rows = list(itertools.product(("ok", "revisar", "sin cambio", "sin match"), (50, 90), (None, 0.0, 5.0), (None, 40.0), no_yes, no_yes, no_yes, no_yes, no_yes, no_yes))
    df = spark.createDataFrame(rows, "s string, score int, cur double, chg double, c boolean, m boolean, o boolean, a boolean, b boolean, y boolean")
    got = df.select(F.struct(*df.columns).alias("r"), classify.alert(*(F.col(c) for c in df.columns)).alias("x")).collect()
    assert all(r["x"] == last_writer(*r["r"]) for r in got) and len(got) == len(rows)


def test_catalog(spark, shop):
    rows = {r["referencia"]: r for r in shop.collect()}
    assert len(rows) == 12 and rows["PAS001"]["producto"] == "Fideos naturales 500 g" and rows["PAS001"]["proveedor"] == "Pastas Río" and rows["PAS001"]["costo_actual"] == 3500
    raw = [(0, "x.1", "A - B - C", "", "1.234,50", "t1"), (1, "", "", "", "", "t2"), (2, "x.2", "Descuento 10%", "", "5", ""), (3, "x.3", "A - B - C", "", "7", ""), (4, "x.4", "Cuota social", "", "1", "")]
    df = spark.createDataFrame(raw, "seq long, id string, name string, default_code string, standard_price string, product_tag_ids string")
    prefixes = spark.createDataFrame([("cuota",)], "empieza_con string")
    got = C.build_catalog(df, non_products=prefixes).collect()
    assert [(r["referencia"], r["costo_actual"], r["etiquetas"], r["marcas"], r["proveedor"]) for r in got] == [("x.1", 1234.5, "t1; t2", "B | C", "C")]
    with pytest.raises(C.ExportError):
        C.resolve_headers(["cantidad a la mano", "name"])


@pytest.fixture(scope="module")
def heard(spark):
    """Lines and notes of each of several messages, read together."""
    index = spark.createDataFrame([(text.normalize_text(s), s, i) for i, s in enumerate(SUPPLIERS)], "key string, canonical string, seq long")

    def read(*texts, start=""):
        frame = spark.createDataFrame([(i, start, t) for i, t in enumerate(texts)], "source_id long, start string, text string")
        got = [r.asDict() for r in messages.read_messages(frame, index).orderBy("source_id", "note", "line_no").collect()]
        return [([r for r in got if r["source_id"] == i and not r["note"]], [r for r in got if r["source_id"] == i and r["note"]]) for i in range(len(texts))]

    return read


def test_messages(heard):
    got = heard(
        "Pastas Río\nFideos naturales 500 g $3600\nSin salames", "harina2000", "u$s 45", "USD 12", "Miel en envases de plástico.\nx250cm3 $3200\nx360cm3 $4500",
        "BRAZUELO $16.900  VACIO $17.500 PULPA $19.300", "01  1001 CLARA. LAVANDINA 1 L   36  900.00  0.00  29160.00", "Licencia Plan Pro mensual (por usuario) 19800",
        "semillas de chia•250g•2000", "no modificamos los precios", "Fideos naturales 500 g\nno hay stock", "aceite 2500", "Fideos $3000\nPastas Río\nPan 2000\nEspecias Lunas\nComino 25 g\n$640\n$700",
        None, "Pan de campo\n3100\n3200\n3300", "Hola! Buen día: fideos $3500", "[12/3/24, 10:00] Pastas Río: Fideos 500 g $3500\n[12/3/24, 10:01] Pastas Río: Canelones\n$9000\n[12/3/24, 10:02] Dulces del Sur: imagen omitida",
        "Prepizzas integrales $5500\nde espinaca\nde calabaza", "te paso la lista\nSabores:\nLlamar al 1144445555", "Pan 2000 (2600)", "Fideos 3600 y pan $ 12345678", "Codigo\tPan de campo\tPastas Río\t$ 3.100,50", "no modifiqué los precios",
    )
    rows, notes = got[0]
    assert [(r["kind"], r["description"]) for r in rows] == [("costo", "Fideos naturales 500 g"), ("faltante", "salames")] and rows[0]["supplier"] == "Pastas Río"
    assert got[1][0][0]["cost"] == 2000 and got[2][0] == [] and len(got[2][1]) == 1 and got[3][0] == [] and len(got[3][1]) == 1
    assert [r["description"] for r in got[4][0]] == ["Miel en envases de plástico x250cm3", "Miel en envases de plástico x360cm3"]
    assert [r["cost"] for r in got[5][0]] == [16900, 17500, 19300]
    assert [r["cost"] for r in got[6][0]] == [810]
    assert got[7][0][0]["description"] == "Licencia Plan Pro mensual (por usuario)" and got[7][0][0]["cost"] == 19800
    assert got[8][0] == [] and len(got[8][1]) == 1
    assert got[9] == ([], [])  # not one of the phrases
    assert got[22][0] == [] and [n["what"] for n in got[22][1]] == [messages.SAME_NOTE]
    assert [(r["kind"], r["description"]) for r in got[10][0]] == [("faltante", "Fideos naturales 500 g")]
    assert got[11][0][0]["cost"] == 2500
    # blocks by supplier; a price alone goes to the line above once
    assert [(r["supplier"], r["description"], r["cost"]) for r in got[12][0]] == [("", "Fideos", 3000), ("Pastas Río", "Pan", 2000), ("Especias Luna", "Comino 25 g", 640), ("Especias Luna", "", 700)]
    assert got[13] == ([], [])
    assert [(r["description"], r["cost"]) for r in got[14][0]] == [("Pan de campo", 3100), ("3200", 3300)]
    assert [(r["description"], r["cost"]) for r in got[15][0]] == [("fideos", 3500)]
    assert [(r["supplier"], r["description"], r["cost"]) for r in got[16][0]] == [("Pastas Río", "Fideos 500 g", 3500), ("Pastas Río", "Canelones", 9000)]
    assert [(r["description"], r["cost"]) for r in got[17][0]] == [("Prepizzas integrales de espinaca", 5500), ("Prepizzas integrales de calabaza", 5500)]
    assert got[18][0] == []
    assert [(r["description"], r["cost"], r["suggested"]) for r in got[19][0]] == [("Pan", 2000, 2600)]
    assert [(r["supplier"], r["cost"]) for r in got[21][0]] == [("Pastas Río", 3100.5)]


def test_alike_names_lose_no_pair(spark):
    import random

    from pricelode.operators.alike import name_pairs

    rng = random.Random(8)
    words = ["distribuidora", "norte", "sur", "pastas", "rio", "la", "quesera", "luna", "a", "ab", "molino", "panaderia", "don", "jose"]

    def spoilt(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice("aeiosx") + w[k:], w[:k] + w[k + 1 :], w])

    def name():
        got = [rng.choice(words) for _ in range(rng.randrange(1, 5))]
        return " ".join(x for w in got for x in [spoilt(w) if rng.random() < 0.3 else w] if x.strip())

    left, right = ({name() for _ in range(150)} - {""} for _ in range(2))
    frames = [spark.createDataFrame([(x,) for x in sorted(s)], "name string") for s in (left, right)]
    for scorer, f, cut in (("set", fuzzy.token_set, 88), ("set", fuzzy.token_set, 92), ("sort", fuzzy.token_sort, 85), ("sort", fuzzy.token_sort, 93)):
        want = {(a, b) for a in left for b in right if f(a, b) >= cut}
        got = {(r["l"], r["r"]) for r in name_pairs(*frames, scorer, cut).collect()}
        assert want and got == want


def test_alike_names_meet_few(spark):
    """Of all pairs of 10,000 names few are scored, and none that scores the cut is missed (against all pairs of some of them)."""
    import random

    from pricelode.operators.alike import candidates

    rng = random.Random(5)
    parts = ["ma", "re", "lo", "ti", "san", "pre", "ca", "do", "ne", "qui", "bar", "le", "go", "mi", "to", "cho", "pa", "fi", "ru", "vel"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(700)]
    weights = [1 / (i + 5) for i in range(700)]

    def spoilt(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice("aeiosx") + w[k:], w[:k] + w[k + 1 :]])

    names = set()
    while len(names) < 10_000:
        words = [spoilt(w) if rng.random() < 0.08 else w for w in rng.choices(vocabulary, weights, k=rng.randint(2, 5))]
        names.add(" ".join(x for x in [*words, *([f"{rng.choice([100, 250, 500])} g"] if rng.random() < 0.5 else [])] if x))
    right = sorted(names)
    left = rng.sample(right, 60)
    frames = [spark.createDataFrame([(x,) for x in s], "name string") for s in (left, right)]
    for scorer, f, cut in (("set", fuzzy.token_set, 85), ("set", fuzzy.token_set, 88), ("sort", fuzzy.token_sort, 93)):
        got = {(r["l"], r["r"]) for r in candidates(*frames, scorer, cut).collect()}
        assert len(got) < 0.005 * len(left) * len(right)
        assert {(a, b) for a in left for b in right if f(a, b) >= cut} <= got


def test_best_products_equal_full_scoring(spark, monkeypatch):
    """The best three of each text, of texts that share no word with any name and of unknown suppliers too."""
    import random

    from pricelode.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 40)
    rng = random.Random(3)
    words = ["miel", "pura", "harina", "integral", "de", "trigo", "sarraceno", "aceite", "oliva", "extra", "yerba", "mate", "x", "500", "g", "kg", "cacao", "amargo"]
    catalog = []
    for i in range(300):
        catalog.append((f"r{i}", i, " ".join(rng.choices(words, k=rng.randint(1, 5)))))
    frame = spark.createDataFrame(catalog, "referencia string, seq long, clave string")
    scopes = [("*", r) for r, _, _ in catalog] + [("rio", r) for r, i, _ in catalog if i % 3 == 0] + [("uno", "r7"), ("uno", "r8")]
    texts = ["mil purra", "harinaintegral", "zzz", "aceyte olva", "yerba mate x 500 g", "de", "sarracen", "cacao amargo amargo", "q"]
    asked = [(s, t) for s in ("*", "rio", "uno") for t in texts]
    keys = [(t, k) for t in texts for k in {t, t.split()[0]}]
    got = matching.candidates(
        spark.createDataFrame(asked, "scope string, text string"), spark.createDataFrame(keys, "text string, key string"), spark.createDataFrame(scopes, "scope string, referencia string"), frame
    )
    found = {}
    for r in got.collect():
        found.setdefault((r["scope"], r["text"]), []).append((-round(r["score"], 6), r["seq"]))
    for scope, text in asked:
        inside = {r for s, r in scopes if s == scope}
        full = [(-round(max(0.55 * fuzzy.token_set(k, c) + 0.45 * fuzzy.token_sort(k, c) for t, k in keys if t == text), 6), i) for r, i, c in catalog if r in inside]
        assert sorted(found[scope, text]) == sorted(full)[:3]


def test_candidates_are_kept_between_cycles(spark, tmp_path, monkeypatch):
    """Later cycles equal full scoring, and score what is new: nothing in an unchanged one."""
    import random

    from pricelode.operators import matching

    rng = random.Random(5)
    words = ["miel", "pura", "harina", "integral", "trigo", "aceite", "oliva", "yerba", "mate", "500", "g", "cacao"]
    catalog = [(f"r{i}", i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(120)]
    texts = ["mil purra", "harina integral", "zzz", "aceyte olva", "yerba mate 500 g", "trigo"]
    met = []
    scored = matching._scored

    def counted(pairs):
        met.append(pairs.select("scope", "key", "clave").distinct().count())
        return scored(pairs)

    monkeypatch.setattr(matching, "_scored", counted)
    view = matching.View(spark, f"file://{tmp_path}/view")

    def cycle_of(rows, said, abbreviated=""):
        """The pairs that the view's cycle scored; its rows are those of scoring everything."""
        products = spark.createDataFrame(rows, "referencia string, seq long, clave string")
        bridge = [("*", r) for r, _, _ in rows] + [("rio", r) for r, i, _ in rows if i % 3 == 0]
        asked, keys = [(s, t) for s in ("*", "rio") for t in said], [(t, k) for t in said for k in {t, t.split()[0] + (abbreviated if t == "trigo" else "")}]
        met.clear()
        found = {a: [] for a in asked}
        for r in matching.candidates(
            spark.createDataFrame(asked, "scope string, text string"), spark.createDataFrame(keys, "text string, key string"), spark.createDataFrame(bridge, "scope string, referencia string"), products, view=view
        ).collect():
            found[r["scope"], r["text"]].append((-round(r["score"], 6), r["seq"]))
        for scope, text_ in asked:
            full = [(-round(max(0.55 * fuzzy.token_set(k, c) + 0.45 * fuzzy.token_sort(k, c) for t, k in keys if t == text_), 6), i) for r, i, c in rows if (scope, r) in bridge]
            assert sorted(found[scope, text_]) == sorted(full)[:3]
        return sum(met)

    full = cycle_of(catalog, texts)
    assert cycle_of(catalog, texts) == 0 < full
    # rows in front, so that all move on, of names that are new; one text more
    more = [("n1", 0, "mil pura"), ("n2", 1, "yerba mate 500"), *((r, i + 3, n) for r, i, n in catalog)]
    assert 0 < cycle_of(more, [*texts, "cacao"]) < full / 2
    # the best one goes, a text's keys change, another isn't asked
    assert 0 < cycle_of([x for x in more if x[0] != "n1"], texts[1:], " entero") < full
    cycle_of([], texts)
    assert len([x for x in (tmp_path / "view").iterdir() if x.is_dir()]) == 2


def test_lists(spark):
    names = spark.createDataFrame([("pasta rio", "Pastas Río"), ("zanoni", "Zanoni")], "key string, canonical string")

    def read(*lines):
        df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "source_id long, line_no long, line string")
        got, unread = pricelists.text_articles(df, names)
        return [r.asDict() for r in got.orderBy("line_no").collect()], [r["line"] for r in unread.collect()]

    a, _ = read("80018 Aceite ZANONI Girasol x 900cc (12 UxB) ZANONI $ 2.598 0", "81671 Aceite ZANONI Maiz x 900cc ZANONI $ 1 4.294 0")
    assert [x["price"] for x in a] == [2598.0, 14294.0] and "UxB" not in a[0]["description"] and a[0]["brand"] == "Zanoni"
    b, _ = read("AL-0014 ATUN BAHIA LOMITO NATUR 170GR PR 2670.631 48", "AL-0286 ARVEJAS 300GR 452.111 150 NUEVO")
    assert [x["price"] for x in b] == [2670.631, 452.111] and "PR" not in b[0]["description"]
    c, _ = read("7795933000496 Atun aceite 1,721.00 18.78% 1397,88", "7795933000502 01-0112 Atún Lomitos al Natural (Ecuador) 88 48 x 170 grs. 2,226.21 18.78% 1,808.13", "7790000000059 01-0172 Caballa SIN STOCK 88 24 x 380 gr. 0.00 18.78% 0.00")
    assert [(x["code"], x["price"], x["no_stock"]) for x in c] == [("7795933000496", 1397.88, False), ("01-0112", 1808.13, False), ("01-0172", 0.0, True)] and " 88 " not in c[1]["description"]
    d, unread = read("PASTAS RIO", "80018 Fideos x 500 g $ 2.598", "CUBE TRUMPET BIG 7814.282 6 NUEVO")
    assert d[0]["section"] == "Pastas Río" and unread == ["CUBE TRUMPET BIG 7814.282 6 NUEVO"]


def test_tables(spark):
    names = spark.createDataFrame([("molino pampa", "Molino Pampa")], "key string, canonical string")
    text_ = "OBSERVACIONES;;;\nCódigo;Descripción;Marca;Precio s/IVA\n30011;HARINA 000;MOLINO PAMPA;1.808,13\n30012;FIDEOS;OTRA;980,50\n".encode()
    files = spark.createDataFrame([(1, "lista.csv", bytearray(text_))], "source_id long, name string, content binary")
    got = [r.asDict() for r in pricelists.table_articles(files, names).orderBy("line_no").collect()]
    assert [(x["code"], x["price"], x["brand"]) for x in got] == [("30011", 1808.13, "Molino Pampa"), ("30012", 980.5, "")]
    shape = "source_id long, tab_no int, row_no long, col int, value string"
    tables = {
        1: [["a", "b"], ["x", "y"]],  # no price
        2: [["Fideos", "Pan", "1550"], ["x", "y", "1600"]],  # the first row is an article
        3: [["ID Artículo", "Descripción", "Marca", "Precio de Venta"], ["7", "Pan", "Espiga", "$ 10,50"]],
        4: [["LISTA DE OCTUBRE"], ["", "vigente"], ["detalle", "cod", "", "unitario", "valor"], ["Miel", "A1", "z", "5", "6"]],  # two named prices: the left one
        5: [["ref", "texto largo", "n"], ["1", "una cosa", "9"], ["b", "otra cosa", "8"], ["c", "cosa", ""]],  # the most numeric and the longest
        6: [["producto"]],
        7: [["articulo", "articulo", "neto"], ["A-1", "Yerba mate", "5"]],  # one name for two fields
    }
    frame = spark.createDataFrame([(s, 0, n, c, v) for s, rows in tables.items() for n, r in enumerate(rows) for c, v in enumerate(r) if v], shape)
    got = {r["source_id"]: tuple(r)[2:] for r in cells.columns_of(frame).collect()}
    assert got == {1: (1, None, None, None, 0), 2: (0, 2, None, None, 0), 3: (1, 3, 2, 0, 1), 4: (3, 3, None, 1, 0), 5: (1, 2, None, None, 1), 6: (1, None, None, None, 0), 7: (1, 2, None, 0, 1)}
    assert {r["source_id"]: r["labels"] for r in cells.without_price(frame).collect()} == {1: "a, b", 6: "producto"}
    lines = {(r["source_id"], r["line_no"]): (r["code"], r["description"], r["brand"], r["price"], r["line"]) for r in cells.table_lines(frame).collect()}
    assert lines[2, 0] == ("", "Fideos", "", "1550", "Fideos · Pan · 1550") and lines[3, 0] == ("7", "Pan", "Espiga", "10,50", "7 · Pan · Espiga · $ 10,50")
    assert cells.table_lines(frame.limit(0)).isEmpty() and len(lines) == 8


def test_books(spark):
    """A book of unlike tabs in one plan: roles by columns, the first tab of messages alone."""
    import io
    import zipfile

    tabs_ = {
        "Notas": [["cosas"], ["x"]],
        "Manual": [["Chequeado", "Proveedor"], ["x", "Don Tito"], ["", "La Feria"]],
        "Semana": [["Proveedor", "Chequeado", "Mensaje", "Fecha de actualización"], ["La Espiga", "SI", "Pan $10", "01/10"], ["", "SI", "sin dueño", ""], ["Pastas Río", "", "", ""]],
        "Listas": [["PROVEEDOR", "Nos envía"], ["Distribuidora Norte", "pdf"], ["Distribuidora Sur", "xlsx"]],
        "Vieja": [["Proveedor", "Mensaje"], ["La Espiga", "Pan $5"]],
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(tabs_)
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{9 - i}.xml"/>' for i in range(5)) + "</Relationships>")
        for i, n in enumerate(names):
            rows = "".join("<row>" + "".join(f"<c t='inlineStr'><is><t>{c}</t></is></c>" for c in r) + "</row>" for r in tabs_[n])
            z.writestr(f"xl/worksheets/sheet{9 - i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    files = [(1, "libro.xlsx", bytearray(out.getvalue())), (2, "otro.csv", bytearray("Proveedor,Nos envía\nNorte,pdf\n".encode()))]
    book = cells.file_cells(spark.createDataFrame(files, "source_id long, name string, content binary"))
    rows = cells.book_rows(book).cache()
    said = [tuple(r) for r in rows.filter("source_id = 1").orderBy("tab_no", "seq").select("tab", "role", "supplier", "message", "checked", "updated").collect()]
    assert said == [
        ("Manual", "manual", "Don Tito", "", "x", ""), ("Manual", "manual", "La Feria", "", "", ""), ("Semana", "messages", "La Espiga", "Pan $10", "SI", "01/10"), ("Semana", "messages", "Pastas Río", "", "", ""),
        ("Listas", "lists", "Distribuidora Norte", "", "", ""), ("Listas", "lists", "Distribuidora Sur", "", "", ""),
    ]
    assert [r["source_id"] for r in cells.without_messages(book).collect()] == [2]
    sheet, expected, manual = sheets.book_parts(rows)
    assert [tuple(r)[2:5] for r in sheet.orderBy("seq").collect()] == [("La Espiga", True, "Pan $10"), ("Pastas Río", False, "")]
    assert expected.count() == 3 and {(r["supplier"], r["checked"]) for r in manual.collect()} == {("Don Tito", True), ("La Feria", False)}


def test_pages(spark):
    """Two columns are told by codes that line up and go on; a price at a row's end is none. Lines of boxes hang on their first box."""
    from pricelode.sources import pages

    word = lambda page, text, x, top, wide=45: (page, 1000.0, text, float(x), float(x + wide), float(top))
    two = [w for i in range(5) for w in (word(1, f"AL-{i:04d}", 20, 15 * i), word(1, "Fideos", 75, 15 * i), word(1, "$1000", 130, 15 * i), word(1, f"AL-{9000 + i}", 400, 15 * i), word(1, "Aceite", 455, 15 * i), word(1, "$2000", 510, 15 * i))]
    one = [w for i in range(6) for w in (word(2, f"AL-{i:04d}", 20, 15 * i), word(2, "Vino Malbec 750cc", 75, 15 * i, 140), word(2, "15713", 410, 15 * i))]
    words = spark.createDataFrame([*two, *one, word(3, "solo", 1, 1)], "page int, width double, text string, x0 double, x1 double, top double")
    assert dict(pages.column_cuts(words).collect()) == {1: 398.5, 2: None, 3: None}
    lines = [r["text"] for r in pages.column_lines(words).filter("page = 1").orderBy("side", "line").collect()]
    assert lines[0] == "AL-0000 Fideos $1000" and lines[5] == "AL-9000 Aceite $2000" and len(lines) == 10
    boxes = [((0, 0), (9, 10), "Miel"), ((20, 1), (29, 11), "$1O0"), ((0, 30), (5, 40), "Pan"), ((40, 5), (50, 15), "sin O"), ((60, 7), (70, 17), "far")]
    photo = spark.createDataFrame([(7, bytearray(b"x"))], "page int, content binary")
    got = pages.photo_lines(photo, lambda content: [([a, b], t) for a, b, t in boxes])
    assert [r["text"] for r in got.orderBy("line").collect()] == ["Miel  $100  sin O", "far", "Pan"]
    with pytest.raises(RuntimeError):
        pages.photo_lines(photo, None)


def test_sheets(spark):
    raw = spark.createDataFrame([(0, "A", "si", "x $1"), (1, "B", "no", ""), (2, "", "si", "z")], "seq long, Proveedor string, Chequeado string, Mensaje string")
    assert [(r["supplier"], r["checked"], r["message"]) for r in sheets.sheet_rows(raw).orderBy("seq").collect()] == [("A", True, "x $1"), ("B", False, "")]
    assert sheets.csv_url("https://docs.google.com/spreadsheets/d/abc/edit#gid=7") == "https://docs.google.com/spreadsheets/d/abc/export?format=csv&gid=7"
    assert sheets.book_link("https://docs.google.com/spreadsheets/d/abc/edit#gid=7") == "https://docs.google.com/spreadsheets/d/abc/export?format=xlsx"
    links = spark.createDataFrame([(4, "https://docs.google.com/spreadsheets/d/abc")], "source_id long, link string")
    assert sheets.remote_books(links, lambda url: b"PK" + url[-4:].encode()).first()["content"] == b"PKxlsx"
    assert office.kind_of("a.csv", b"Proveedor,Mensaje\n") == "sheet"
    with pytest.raises(PermissionError):
        sheets.download("https://docs.google.com/spreadsheets/d/abc", lambda url: b"<html>")
    loaded, expected = spark.createDataFrame([("Distribuidora Norte",)], "supplier string"), spark.createDataFrame([("Distribuidora Norte SA",), ("Otro",)], "supplier string")
    assert [r[0] for r in sheets.missing_lists(expected, loaded).collect()] == ["Otro"]


def test_memory(spark):
    old = spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], "seq long, k string, v string")
    new = spark.createDataFrame([(0, "a", "9"), (1, "c", "3")], "seq long, k string, v string")
    assert sorted((r["k"], r["v"]) for r in memory.upsert(old, new, ["k"]).collect()) == [("a", "9"), ("b", "2"), ("c", "3")]
    assert sorted((r["k"], r["v"]) for r in memory.insert_absent(old, new, ["k"]).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert memory.aligned(spark.createDataFrame([("x",)], "texto string"), "alias").columns == ["seq", *memory.TABLES["alias"]]


def test_verify(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, name string, cost double")
    before, after = t([("a", "A", 1.0), ("b", "B", 2.0)]), t([("a", "A", 5.0), ("b", "B", 2.0), ("n", "A", 1.0)])
    expected = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("z", 1.0)], "id string, cost double")
    assert {r["id"]: r["state"] for r in verify.verify(expected, before, after).collect()} == {"a": "ok", "b": "no se actualizó", "z": "no aparece"}
    assert [r["id"] for r in verify.new_products(before, after).collect()] == ["n"] == [r["id"] for r in verify.repeated_names(before, after).collect()]
    with pytest.raises(verify.ImportRefused):
        verify.refuse_bad(spark.createDataFrame([("no id", 1.0)], "id string, standard_price double"))


def test_suppliers_register_and_say_their_tax(spark):
    from pricelode.operators import providers

    cards = memory.aligned(spark.createDataFrame([(0, "La Quesera", "LQ", "", "", "fijo", "")], "seq long, nombre string, alias string, tipo string, iva_lista string, margen string, nota string"), "proveedores")
    asked = spark.createDataFrame([("lq", "lista"), ("Don  Tito", "mensaje"), ("don tito", "")], "asked string, tipo string")
    got = {r["nombre"]: r["tipo"] for r in providers.register(asked, cards).collect()}
    assert got["La Quesera"] == "lista" and len(got) == 2 and got[next(k for k in got if k.lower() == "don tito")] == "mensaje"
    taxes = memory.aligned(spark.createDataFrame([(0, "proveedor", "la quesera", "0.105", "0", "", "")], "seq long, ambito string, clave string, iva string, percepcion string, nota string, incluido string"), "impuestos")
    said = spark.createDataFrame([("La Quesera", "21+3"), ("Nuevo", "mixto"), ("Otro", "nada")], "asked string, iva_lista string")
    new_cards, rules = providers.set_tax(said, cards, taxes)
    assert {r["nombre"]: r["iva_lista"] for r in new_cards.collect()} == {"La Quesera": "21+3", "Nuevo": "mixto"}
    assert {r["clave"]: (r["iva"], r["percepcion"]) for r in rules.collect()} == {"La Quesera": ("0.21", "0.03"), "Nuevo": (K.PER_PRODUCT, "0.0")}


def test_answers_of_a_cycle(spark, store):
    answers = cycle.Answers()
    row = {"huella": "h", "clave_renglon": "k", "referencia": "R"}
    for action in ("forzar", "aprobar", "fuente_ok", "saltar"):
        cycle.decide(store, row, action, answers=answers)
    assert answers.arguments() == {"approved": [("k", "R")], "skipped": ["k"], "source_ok": [("k", "R")], "forced": ["h"]}
    assert cycle.Answers.of(answers.rows(spark)).arguments() == answers.arguments()
    cycle.decide(store, row, "restaurar", answers=answers)
    assert answers.arguments()["skipped"] == []


def test_export_file(spark, tmp_path):
    from pricelode.sources import exports

    (tmp_path / "e.csv").write_text('id,name,default_code,standard_price,product_tag_ids\nx.1,"A ""doble"" - B - C",,"1.234,50",t1\n,,,,t2\n', encoding="utf-8")
    got = C.build_catalog(exports.read_csv(spark, str(tmp_path / "e.csv"))).collect()
    assert [(r["referencia"], r["costo_actual"], r["etiquetas"], r["nombre_completo"]) for r in got] == [("x.1", 1234.5, "t1; t2", 'A "doble" - B - C')]


def test_cycle(spark, shop, store):
    store.put("alias", [{"texto": "Prepizzas", "referencia": "DUL001", "proveedor": "Dulces del Sur"}, {"texto": "c/miel", "referencia": "PAS002", "proveedor": "Pastas Río"}])
    store.put("reglas_proveedor", [{"proveedor": "Embutidos Sierra", "cotiza_por": "kilo"}])
    message = "Pastas Río\nFideos naturales 500 g $3600\nc/miel 3800\nCosa rara de otro mundo $77\nEspecias Luna\nOrégano x 25 g $650\nEmbutidos Sierra\nBondiola feteada $22000\nSin salames"
    got = run(spark, shop, store, message)
    ready = {r["referencia"]: r for r in got["listos"].collect()}
    assert {k: r["costo_nuevo"] for k, r in ready.items()} == {"PAS001": 3600.0, "PAS002": 3800.0, "EMB001": 3300.0}
    alerts = {r["description"]: r["alerta"] for r in got["confirmar"].collect()}
    assert alerts["Cosa rara de otro mundo"] == "sin match" and alerts["Orégano x 25 g"] == "presentación distinta"
    assert {r["referencia"] for r in got["avisos"].collect()} == {"EMB002"}
    table = cycle.import_table(got)
    verify.refuse_bad(table.select("id", "standard_price"))
    assert table.columns == ["id", "default_code", "name", "standard_price"] and table.count() == 3
    assert cycle.history_rows(got, "2026-01-01").count() == 3
    look = {r["referencia"]: r for r in got["control"].collect()}
    assert look.keys() == ready.keys() and look["PAS001"]["kind"] == "fijo"
    assert [tuple(r) for r in got["fuentes"].collect()] == [("m0", 1, 0, 1, 5, 0)]
    # the same message again is no new price; forced, it is
    store.put("procesados", [{"fuente": r["fuente"], "huella": r["huella"], "fecha": "hoy"} for r in got["huellas"].collect()], ["fuente", "huella"], absent=True)
    again = run(spark, shop, store, message)
    assert again["analisis"].count() == 0 and again["notas"].count() == 1


def test_winner_and_source(spark, shop, store):
    got = run(spark, shop, store, "Pastas Río\nFideos naturales 500 g $3600", "Pastas Río\nFideos naturales 500 g $3650")
    assert [r["costo_nuevo"] for r in got["listos"].collect()] == [3650.0]
    lost = got["confirmar"].first()
    assert lost["win_costo_nuevo"] == 3650.0 and lost["alerta"].startswith("otro renglón")
    strong = run(spark, shop, store, "Pastas Río\nFideos naturales 500 g $9000")["confirmar"].first()
    assert strong["alerta"] == "variación fuerte"
    good = run(spark, shop, store, "Pastas Río\nFideos naturales 500 g $9000", approved=[(strong["clave_renglon"], "PAS001")])
    assert good["listos"].count() == 1


def test_list_cycle(spark, shop, store):
    store.put("impuestos", [{"ambito": "proveedor", "clave": "Distribuidora Norte", "iva": "0.21", "percepcion": "0", "incluido": "no"}])
    rows = [(1, "01-01", "FIDEOS NATURALES PASTAS RIO 500 G", 3182.0), (2, "01-02", "TORNILLO 5 MM", 9.0), (3, "01-03", "CANELONES DE VERDURA x 6 PASTAS RIO", 7438.02)]
    articles = spark.createDataFrame([(i, c, d, p, f"{c} {d} {p}") for i, c, d, p in rows], "line_id long, code string, description string, price double, line string")
    for name, value in (("proveedor_bloque", "Distribuidora Norte"), ("brand", ""), ("section", ""), ("fuente", "Distribuidora Norte"), ("origen", "lista"), ("huella", "h")):
        articles = articles.withColumn(name, F.lit(value))
    articles = articles.withColumn("no_stock", F.lit(False)).withColumn("source_order", F.lit(0).cast("long"))
    none = spark.createDataFrame([], cycle.SOURCE)
    got = cycle.run_cycle(shop, store, none, articles)
    asked = {r["codigo"]: r for r in got["confirmar"].collect()}
    assert asked["01-01"]["referencia"] == "PAS001" and asked["01-01"]["alerta"] == "match a confirmar" and got["fuera_de_catalogo"].count() == 1
    cycle.decide(store, asked["01-01"].asDict(), "elegir", "PAS001")
    ready = cycle.run_cycle(shop, store, none, articles)["listos"].collect()
    assert [(r["referencia"], r["costo_nuevo"], r["variacion"]) for r in ready] == [("PAS001", pytest.approx(3850.22), 10.0)]


def docx(*parts):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda c: f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" if isinstance(p, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in p) + "</w:tbl>" for p in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({c for r in rows for c in r})
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{shared.index(c)}</v></c>' for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_any_list(spark):
    from pricelode.sources import lists

    table = [["Código", "Descripción", "Precio"], ["30011", "HARINA 000", "980,50"], ["30012", "FIDEOS", "1.200,00"]]
    files = [(1, "a.docx", docx("Lista", table)), (2, "b.docx", docx("80018 Aceite Girasol x 900cc $ 2.598")), (3, "c.xlsx", xlsx(table)), (4, "d.txt", "Fideos frescos $ 100\nPan $50".encode()), (5, "e.pdf", b"%PDF-1")]
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in files], "source_id long, name string, content binary")
    names = spark.createDataFrame([], "key string, canonical string")
    articles, unread, texts = lists.read_lists(df, names, pdf=lambda content: ["AL-0014 ATUN LOMITO 170GR 2670.631 48"])
    got = sorted((r["source_id"], r["code"], r["price"]) for r in articles.collect())
    assert got == [(1, "30011", 980.5), (1, "30012", 1200.0), (2, "80018", 2598.0), (3, "30011", 980.5), (3, "30012", 1200.0), (5, "AL-0014", 2670.631)]
    assert [r["source_id"] for r in texts.collect()] == [4] and unread.count() == 0


def test_lookups(spark, shop):
    from pricelode.operators import providers

    cards = memory.aligned(spark.createDataFrame([(0, "La Quesera", "Lácteos Don Julio | DJ", "21", ""), (1, "Bebidas Sur", "", "mixto", "variable")], "seq long, nombre string, alias string, iva_lista string, margen string"), "proveedores")
    asked = spark.createDataFrame([("lacteos don julio",), ("Bebidas  Sur",), ("nadie",)], "asked string")
    assert {r["asked"]: r["nombre"] for r in providers.find_cards(asked, cards).collect()} == {"lacteos don julio": "La Quesera", "Bebidas  Sur": "Bebidas Sur"}
    typed = spark.createDataFrame([("comino 25 g - especias luna",), ("x",)], "asked string")
    assert [r["referencia"] for r in providers.find_products(typed, shop).collect()] == ["ESP002"]
    assert [r["margen"] for r in providers.supplier_list(cards).collect()] == ["variable", "fijo"]
    assert {r["nombre"]: (r["known"], r["per_product"]) for r in providers.tax_known(cards).collect()} == {"La Quesera": (True, False), "Bebidas Sur": (True, True)}


def test_choosing_again_keeps_the_units(spark):
    store = cycle.Store(spark)
    row = {"es_lista": True, "codigo": "01-01", "proveedor_bloque": "Distribuidora Sur", "description": "fideos", "referencia": "PAS001"}
    cycle.decide(store, row, "bulto", "12")
    cycle.decide(store, row | {"codigo": "0101", "proveedor_bloque": "DISTRIBUIDORA  sur"}, "elegir", "PAS002")
    cycle.decide(store, row | {"codigo": "02"}, "elegir", "PAS003")
    got = [(r["codigo_proveedor"], r["referencia_odoo"], r["unidades"]) for r in store.read("codigos_proveedor").orderBy("seq").collect()]
    assert got == [("0101", "PAS002", "12"), ("02", "PAS003", "")]
    cycle.decide(store, row, "bulto", "6")
    assert {(r["codigo_proveedor"], r["unidades"]) for r in store.read("codigos_proveedor").collect()} == {("01-01", "6"), ("02", "")}
