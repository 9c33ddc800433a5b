"""A whole demo store: its first cycle, and the one after a person's answers.

The products, messages, lists and memory are fixed values; what comes out is known from them.
"""

from pyspark.sql import functions as F

from pricelode.operators import catalog as C
from pricelode.plans import cycle
from pricelode.sources import pricelists

# Reference, name, cost, price.
PRODUCTS = [
    ('PAN001', 'Pan de campo 800 g - Panadería La Espiga', '2500.00', '3750.00'),
    ('PAN002', 'Pan integral 600 g - Panadería La Espiga', '2300.00', '3450.00'),
    ('PAN003', 'Prepizza napolitana x 2 - Panadería La Espiga', '2000.00', '3000.00'),
    ('PAN004', 'Budín de limón 350 g - Panadería La Espiga', '3200.00', '4800.00'),
    ('PAN005', 'Budín de chocolate 350 g - Panadería La Espiga', '3400.00', '5100.00'),
    ('PAS001', 'Fideos al huevo 500 g - Pastas Río', '2800.00', '4200.00'),
    ('PAS002', 'Ravioles de ricota 1 kg - Pastas Río', '6000.00', '9000.00'),
    ('PAS003', 'Ñoquis de papa 750 g - Pastas Río', '3000.00', '4500.00'),
    ('PAS004', 'Canelones de verdura x 6 - Pastas Río', '8000.00', '12000.00'),
    ('LAC001', 'Queso cremoso 500 g - Lácteos Don Julio', '6400.00', '9600.00'),
    ('LAC002', 'Queso reggianito 250 g - Lácteos Don Julio', '4700.00', '7050.00'),
    ('LAC003', 'Dulce de leche 400 g - Lácteos Don Julio', '3200.00', '4800.00'),
    ('LAC004', 'Yogur natural 1 l - Lácteos Don Julio', '2900.00', '4350.00'),
    ('LAC005', 'Queso azul 200 g - Lácteos Don Julio', '3900.00', '5850.00'),
    ('ESP001', 'Orégano 25 g - Especias Luna', '600.00', '900.00'),
    ('ESP002', 'Pimentón 25 g - Especias Luna', '610.00', '915.00'),
    ('ESP003', 'Comino 25 g - Especias Luna', '640.00', '960.00'),
    ('ESP004', 'Canela molida 25 g - Especias Luna', '700.00', '1050.00'),
    ('MIE001', 'Miel 500 g - Miel del Monte', '4750.00', '7125.00'),
    ('MIE002', 'Miel 1 kg - Miel del Monte', '7300.00', '10950.00'),
    ('MIE003', 'Miel (envase plástico) 250 g - Miel del Monte', '3000.00', '4500.00'),
    ('EMB001', 'Bondiola feteada 150 g - Embutidos La Sierra', '3200.00', '4800.00'),
    ('EMB002', 'Salame picado grueso 300 g - Embutidos La Sierra', '5900.00', '8850.00'),
    ('EMB003', 'Jamón crudo feteado 100 g - Embutidos La Sierra', '2300.00', '3450.00'),
    ('LIM001', 'Lavandina 1 l - Limpieza Clara', '850.00', '1275.00'),
    ('LIM002', 'Detergente 750 cc - Limpieza Clara', '1400.00', '2100.00'),
    ('CON001', 'Atún lomito al natural 170 g - Conservas Marina', '2100.00', '3150.00'),
    ('CON002', 'Atún desmenuzado 170 g - Conservas Marina', '1000.00', '1500.00'),
    ('CON003', 'Palmitos en trozos 400 g - Conservas Marina', '1450.00', '2175.00'),
    ('CON004', 'Arvejas remojadas 300 g - Conservas Marina', '480.00', '720.00'),
    ('HAR001', 'Harina 000 1 kg - Molino Pampa', '800.00', '1200.00'),
    ('FID001', 'Fideos tallarín secos 500 g - Molino Pampa', '750.00', '1125.00'),
    ('YER001', 'Yerba mate 1 kg - Yerbal del Litoral', '2700.00', '4050.00'),
    ('ACE001', 'Aceite de girasol 900 cc - Óleos del Plata', '2600.00', '3900.00'),
    ('', '10% en tu orden', '0.00', '0.00'),
    ('', 'Cuota social mensual', '0.00', '0.00'),
]

# Supplier, message.
MESSAGES = [
    ('Panadería La Espiga', 'Hola! Te paso los precios de octubre 🙂\n🍞 Pan de campo $2750\nPan integral $2530\nPrepizzas x2 $2200\nBudines $3520 (5280)\n    Limón\n    Chocolate'),
    ('Pastas Río', 'Fideos al huevo 500g $3080\nRavioles ricota x kg $6600\nÑoquis x 750 grs $3300\nCanelones igual'),
    ('La Quesera', 'Cremoso x 500 $7040\nReggianito x 250g $5170\nDulce de leche $3520\nYogur natural 1 litro $3190\nSin quesos azules'),
    ('Especias Luna', 'Orégano x 25 g $660\nPimentón x 25g $671\nComino x 25 g.\n$ 704\nCanela x 50g $1540'),
    ('Miel del Monte', 'Miel en frascos de vidrio.\n360 cm3 (1/2 kilo) $5225\n650 cm3 (1 kg) $8030\nMiel en envases de plástico.\nx200cm3 $3300\nPedidos: 3415550000'),
    ('Embutidos La Sierra', 'LISTA - precios por kilo\nBONDIOLA FET $23467\nSALAME PICADO GRUESO $21633\nJAMON CRUDO FET $25300'),
    ('Limpieza Clara', '01  1001 CLARA. LAVANDINA 1 L          24   935.00   0.00  22440.00\n02  1002 CLARA. DETERGENTE 750 CC      12   1711.11  10.00  18480.00'),
]

# The memory's tables.
MEMORY = {
    'impuestos': [
        {'ambito': 'proveedor', 'clave': 'Distribuidora Norte', 'iva': '0.21', 'percepcion': '0', 'nota': 'la lista dice PRECIOS MAS IVA'},
        {'ambito': 'proveedor', 'clave': 'Distribuidora Sur', 'iva': 'según producto', 'percepcion': '0', 'nota': 'harina al 10,5%, el resto al 21%'},
    ],
    'no_son_productos': [
        {'empieza_con': 'cuota social', 'nota': 'no es un producto'},
    ],
    'proveedor_alias': [
        {'alias': 'La Quesera', 'proveedor': 'Lácteos Don Julio'},
    ],
    'proveedores': [
        {'nombre': 'Panadería La Espiga', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'Pastas Río', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'La Quesera', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo', 'nota': 'en Odoo figura como Lácteos Don Julio'},
        {'nombre': 'Especias Luna', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'Miel del Monte', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'Embutidos La Sierra', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'Limpieza Clara', 'tipo': 'mensaje', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'Verdulería Don Tito', 'tipo': 'manual', 'iva_lista': 'incluido', 'margen': 'fijo'},
        {'nombre': 'Distribuidora Norte', 'alias': 'DN', 'tipo': 'lista', 'iva_lista': '21', 'margen': 'fijo'},
        {'nombre': 'Distribuidora Sur', 'tipo': 'lista', 'iva_lista': 'mixto', 'margen': 'fijo', 'nota': 'harina al 10,5%, el resto al 21%'},
    ],
    'reglas_proveedor': [
        {'proveedor': 'Embutidos La Sierra', 'cotiza_por': 'kilo', 'iva': 'incluido', 'nota': 'manda el precio por kilo'},
    ],
}

NORTH = [
    ("7790000000011 01-0112", "Atún Lomitos al Natural (Ecuador) 88 48 x 170 grs.", "CON001", None), ("7790000000028 01-0111", "Atún Lomitos en Aceite (Ecuador) 88 48 x 170 grs.", None, 1909.10),
    ("7790000000035 01-2013", "Atún Desmenuzado al natural (Ecuador) 88 48 x 170 grs.", "CON002", None), ("7790000000042 01-0127", "Sardinas en aceite (Tailandia) 88 50 x 125 grs.", None, 1320.50),
    ("7790000000059 01-0172", "Caballa al Natural (Nacional) SIN STOCK 88 24 x 380 gr.", None, 0.0), ("7790000000066 02-0146", "Palmitos en Trozos (Ecuador) 88 24 x 400 grs.", "CON003", None),
    ("7790000000073 02-1002", "Arvejas Secas Remojadas 88 24 x 300 grs.", "CON004", None), ("7790000000080 02-1007", "Grano de Choclo Amarillo 88 24 x 300 grs.", None, 601.50),
]
SOUTH = [
    ("30011", "HARINA 000 MOLINO PAMPA 1 KG", "MOLINO PAMPA", "HAR001", 1.105), ("30012", "FIDEOS TALLARIN MOLINO PAMPA 500 G", "MOLINO PAMPA", "FID001", 1.21),
    ("30020", "YERBA MATE YERBAL DEL LITORAL 1 KG", "YERBAL DEL LITORAL", "YER001", 1.21), ("30031", "ACEITE GIRASOL OLEOS DEL PLATA 12 x 900 CC", "OLEOS DEL PLATA", "ACE001", 1.21),
    ("30040", "AZUCAR REFINADA DULCEMAR 1 KG", "DULCEMAR", 980.0, 1), ("30041", "ARROZ LARGO FINO GRANO DE ORO 1 KG", "GRANO DE ORO", 1250.0, 1),
    ("30050", "SAL FINA SALINAS DEL SUR 500 G", "SALINAS DEL SUR", 540.0, 1), ("30051", "VINAGRE DE ALCOHOL CLARITO 1 L", "CLARITO", 870.0, 1),
]


def lists(spark, names):
    """Both distributors' lists, read: lines with a net price, and a table without tax."""
    new = {r: round(float(c) * 1.1) for r, _, c, _ in PRODUCTS}
    lines = ["CONSERVAS MARINA"]
    for code, text, ref, price in NORTH:
        net = new[ref] / 1.21 if ref else price
        lines.append(f"{code} {text} {net / 0.8122:,.2f} 18.78% {net:,.2f}")
    frame = spark.createDataFrame([(100, i, x) for i, x in enumerate([*lines, "PRECIOS MAS IVA"])], "source_id long, line_no long, line string")
    north, unread = pricelists.text_articles(frame, names)
    assert unread.isEmpty()
    price = lambda ref, tax: ref if tax == 1 else round(new[ref] / tax, 2) if ref != "ACE001" else round(round(new[ref] / tax, 2) * 12, 2)
    rows = ["Código;Descripción;Marca;Precio s/IVA", *(f"{c};{d};{b};{price(r, t):.2f}".replace(".", ",") for c, d, b, r, t in SOUTH)]
    south = pricelists.table_articles(spark.createDataFrame([(101, "sur.csv", bytearray("\n".join(rows).encode()))], "source_id long, name string, content binary"), names)
    out = None
    for base, (name, frame) in enumerate((("Distribuidora Norte", north), ("Distribuidora Sur", south)), 1):
        frame = frame.withColumn("line_id", F.col("line_no") + base * 10**6).withColumn("source_order", F.lit(base).cast("long"))
        for column in ("proveedor_bloque", "fuente", "origen", "huella"):
            frame = frame.withColumn(column, F.lit(name))
        frame = frame.select("line_id", "code", "description", "price", "line", "proveedor_bloque", "brand", "section", "fuente", "origen", "huella", "no_stock", "source_order")
        out = frame if out is None else out.unionByName(frame)
    return spark.createDataFrame(out.collect(), out.schema)


def test_demo_store(spark):
    store = cycle.Store(spark)
    for name, rows in MEMORY.items():
        store.put(name, rows)
    raw = [(i, f"__export__.p_{i}", n, r, c, p, "True") for i, (r, n, c, p) in enumerate(PRODUCTS)]
    table = C.build_catalog(spark.createDataFrame(raw, "seq long, id string, name string, default_code string, standard_price string, list_price string, is_published string"), non_products=store.read("no_son_productos"))
    shop = spark.createDataFrame(table.collect(), table.schema)
    assert shop.count() == 34
    articles = lists(spark, cycle.provider_index(shop, store.read("proveedor_alias")).select("key", "canonical"))
    sources = spark.createDataFrame([(i, "planilla", "planilla", s, t, 0) for i, (s, t) in enumerate(MESSAGES)], cycle.SOURCE)
    first = cycle.run_cycle(shop, store, sources, articles)
    ready, asked = first["listos"].collect(), [r.asDict(recursive=True) for r in first["confirmar"].collect()]
    assert len(ready) == 15 and {r["variacion"] for r in ready} == {10.0}  # all that is sure is 10 % up
    assert len(asked) == 17 and first["fuera_de_catalogo"].count() == 7
    assert {r["line"] for r in first["avisos"].collect()} == {"Canelones igual", "Sin quesos azules"}
    answers = cycle.Answers()
    for r in asked:
        if r["alerta"] == "match a confirmar":
            cycle.decide(store, r, "elegir", r["options"][0]["referencia"])
        else:  # the cinnamon comes in another size: not this month
            assert r["alerta"] == "presentación distinta"
            cycle.decide(store, r, "saltar", answers=answers)
    second = cycle.run_cycle(shop, store, sources, articles, **answers.arguments())
    cost = {r["referencia"]: r["costo_nuevo"] for r in second["listos"].collect()}
    assert len(cost) == 27 and abs(cost["CON001"] - 2310) < 0.5 and cost["PAN005"] == 3520
    assert sorted(r["alerta"] for r in second["confirmar"].collect()) == ["falta IVA"] * 4
