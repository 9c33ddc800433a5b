"""Thresholds and word lists. Values here are fixed: results depend on them."""

# Scores (0 to 100) and percentages at which a row is decided.
AUTO_SCORE = 88
DOUBTFUL_SCORE = 62
LIST_SCORE = 70
LOW_SCORE = 75
ALIAS_SET, ALIAS_SORT = 95, 85
IGNORE_SORT = 92
SUPPLIER_SET = 88
PROVIDER_SET, HEADER_SET = 90, 92
TERM_SET, TERM_TOP = 80, 8
TAX_SORT = 93
STRONG_VARIATION = 30.0
EYE_CHECK = 15.0
CENT = 0.01
STALE_DAYS = 60

# Taxes: general and reduced rate, surcharge; and what "per product" is called in a rule.
VAT, REDUCED_VAT, SURCHARGE = 0.21, 0.105, 0.03
PER_PRODUCT = "según producto"
#: option -> (rate, surcharge, included)
TAX_OPTIONS = {
    "incluido": (VAT, 0.0, True),
    "incluido-mixto": (PER_PRODUCT, 0.0, True),
    "21": (VAT, 0.0, False),
    "21+3": (VAT, SURCHARGE, False),
    "mixto": (PER_PRODUCT, 0.0, False),
    "mixto+3": (PER_PRODUCT, SURCHARGE, False),
}
REDUCED_GOODS = (
    r"\b(harinas?|pan(es)?|galletit\w*|facturas?|carnes?|frutas?|verduras?|hortalizas?|legumbres? (frescas?|secas?)|miel a granel)\b"
)

# Words that carry no meaning in a product name.
STOPWORDS = ("de", "del", "la", "el", "los", "las", "con", "y", "en", "por", "sin", "a", "para", "x")
GENERIC_SECTIONS = (
    "vario", "varios", "otro", "otros", "promo", "promos", "oferta", "ofertas",
    "nuevo", "nuevos", "general", "linea", "almacen", "bebida", "bebidas",
)
TRUE_WORDS = ("true", "1", "verdadero", "si", "sí")
CHECKED_WORDS = ("TRUE", "VERDADERO", "SI", "SÍ", "1", "X")
NON_PRODUCT = (
    r"^\s*(\$|\d+\s*%|100%)|^(descuento|env[ií]o|tarjeta de regalo|producto gratis|dep[oó]sito|anticipo|donaci[oó]n(es)?|prueba)\b"
)
ID_HEADERS = ("id", "id externo", "external id", "id_externo")

# Abbreviations of supplier texts, applied in this order after accents are gone.
ABBREVIATIONS = (
    (r"\bac\b", "aceite"), (r"\bac[e]?t\b", "aceite"), (r"\bhar\b", "harina"),
    (r"\bfid\b", "fideos"), (r"\bgall?\b", "galletitas"), (r"\bgalls?\b", "galletitas"),
    (r"\bcons\b", "conserva"), (r"\byerb\b", "yerba"), (r"\bazuc\b", "azucar"),
    (r"\bleg\b", "legumbres"), (r"\bmerm\b", "mermelada"), (r"\bint\b", "integral"),
    (r"\bextra v\.?\b", "extra virgen"), (r"\bv\.?\s*extra\b", "extra virgen"),
    (r"\bnat\b", "natural"), (r"\bdesc\b", "descremado"), (r"\bent\b", "entero"),
    (r"\bch(oc)?\b", "chocolate"), (r"\bdulc?\b", "dulce"), (r"\bpque?t\b", "paquete"),
    (r"\bs/\s*", "sin "), (r"\bc/\s*", "con "),
    (r"\bdesme\b", "desmenuzado"), (r"\bdesmenuz\b", "desmenuzado"), (r"\baceit\b", "aceite"),
    (r"\bnatur\b", "natural"), (r"\bchampig?n?\b", "champignon"), (r"\bfrutill\b", "frutilla"),
    (r"\brodaj\b", "rodajas"), (r"\bdeshues\.?\b", "deshuesado"),
    (r"\bpasta\s+frola\b", "pastafrola"), (r"\bchoris?\b", "chorizos"),
    (r"\broque(fort)?\b", "queso azul"), (r"\bmerme(lada)?s?\b", "mermelada"),
    (r"\bpimi\.?\b", "pimienta"), (r"\bn\.?\s*granos?\b", "negra granos"),
    (r"\brayado\b", "rallado"), (r"\bpre\s+pizza\b", "prepizza"), (r"\bespecies\b", "especias"),
    (r"\bmieles\b", "miel"), (r"\byogur\b", "yogurt"), (r"\bdonitas?\b", "donas"),
    (r"\bnapoletana\b", "napolitano"),
)

#: Headers of price tables by field.
HEADER_HINTS = {
    "codigo": ("codigo", "cod", "sku", "articulo", "art.", "id"),
    "descripcion": ("descripcion", "detalle", "producto", "nombre", "denominacion", "articulo"),
    "precio": ("precio", "costo", "importe", "valor", "unitario", "neto", "lista", "pvp"),
    "marca": ("marca",),
}
