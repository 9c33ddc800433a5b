"""Patterns of quoted lines. What counts as noise, a greeting, a price or a shortage."""

from __future__ import annotations

import re

I = re.I  # noqa: E741
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
NUM = r"\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?"

CHAT_HEADER = re.compile(r"^\s*\[?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})[,]?\s+(\d{1,2}:\d{2})(?::\d{2})?\s*(?:[ap]\.?\s?m\.?)?\]?\s*[-–]?\s*([^:]{1,40}):\s*(.*)$", I)
EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿︀-️←-⇿⬀-⯿]+")
CHAT_NOISE = re.compile(r"(cifrado de extremo a extremo|multimedia omitid|se elimin[oó] este mensaje|imagen omitida|audio omitido|sticker omitido)", I)
GREETING = re.compile(r"^\s*(hola|buen d[ií]a|buenas|holis|gracias|saludos|abrazo|beso|c[oó]mo (est[aá]s|andas)|qu[eé] tal)\b.{0,60}$", I)
NARRATIVE = re.compile(r"^(van? los productos|te paso|paso la lista|aca va|ah[ií] va|lista de|precios? (para|del)|para el (pr[oó]ximo )?ciclo)\b", I)
LABEL = re.compile(r"^\s*(sabores?|variedades?|gustos?|opciones?|rellenos?|sabor|precios?)\s*:?\s*$", I)
INTERJECTION = re.compile(r"\b(uu+h+|bue+no?|che|ah+|eh+|mmm+|jaja\w*|uf+|ay+)\b", I)
TRAILING = re.compile(r"[\s,]*\b(y|e|o|los?|las?|el|la|de|del)\s*$", I)
BULLET = re.compile(r"^\s*[\*\-–—•·>]+\s*")
CASE_NOISE = re.compile(r"\(?\s*\d{0,4}\s*(?:u\s*x\s*b|ux b|unidades? por bulto)\s*\)?", I)
STOCK_NOISE = re.compile(r"\b(sin\s+l[ií]m[ií]te\s+de\s+stock|sin\s+limte\s+de\s+stock|(?<!no\s)(?:con|hay)\s+stock|stock\s+(disponible|permanente))\b", I)
SECTION = re.compile(r"^\s*(novedad|nuevo|nueva|atenci[oó]n|importante|oferta|promo)\b", I)
FOOTER = re.compile(r"^\s*(precios?\s+por\s+kilo|envasado|los?\s+precios?\s+son|hechos?\s+con|elaborad|sin\s+conservantes)\b", I)
NO_CHANGES = re.compile(r"\bno (modifiqu[eé]|cambi[eé]|toqu[eé]|actualic[eé])\b.{0,40}\bprecios?\b|\bprecios? (siguen? igual|sin cambios?|se mantienen?)\b|\bquedan? igual\b", I)
SAME = re.compile(r"\b(igual(es)?|sin cambios?|se mantienen?|mismo precio|como (siempre|el mes pasado))\s*[)\].]*\s*$", I)
MISSING = re.compile(
    r"\b(no hay|no tenemos|no tengo|sin stock|agotad[oa]s?|no va(?:mos)? a (?:haber|tener)|no viene|no llega|suspendid[oa]|no disponible|discontinuad[oa]|"
    r"fuera de stock|no producimos|pausad[oa]|hasta nuevo aviso|no entra|no hacemos|no sale)\b",
    I,
)
WITHOUT = re.compile(r"^\s*sin\s+(?!stock\b)([a-záéíóúñ][\w\sáéíóúñ]{2,40})$", I)
BACK = re.compile(r"\b(vuelve|ya hay|volvi[oó]|repuesto|de nuevo disponible|hay de nuevo)\b", I)
MONTH = re.compile(f"({MONTHS})", I)
FILLER = re.compile(rf"\b(este mes|por ahora|hasta nuevo aviso|por el momento|se retoma.*|vuelve.*|en ({MONTHS})|de ({MONTHS})|lo siento|chicos|gente)\b", I)
TWO_PRICES = re.compile(rf"\$?\s*({NUM})\s*\(\s*\$?\s*({NUM})\s*\)")
PRICE = re.compile(rf"(?<!\d)\$\s?({NUM})|(?<![\w,.$])({NUM})\s*(?:\.-|pesos)(?![\w%])")
LAST_NUMBER = re.compile(rf"(?:[\s:\-–=]\s*|(?<=[a-zA-Záéíóúñ]))({NUM})\s*$")
ONLY_PRICE = re.compile(rf"\s*\$?\s*({NUM})\s*")
PHONE = re.compile(r"\d{8,}")
DOLLARS = re.compile(r"\bu\$s\b|\bus\$|\busd\b", I)
CONTACT = re.compile(
    r"^\s*(pedidos?|tel[eé]fono|tel|cel(ular)?|whats?app|wsp|contacto|cbu|cvu|alias|e-?mail|mail|instagram|ig|facebook|direcci[oó]n|horarios?)\b\s*[:.]?", I
)
ONLY_DATE = re.compile(r"^\s*\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4}\s*$")
ONLY_PHONE = re.compile(r"^\s*\+?(?=(?:\D*\d){7})[\d\s()\-.]+$")
CONDITIONS = re.compile(r"\b(compras?|pedidos?|montos?)\s+m[ií]nim|\benv[ií]os?\b.{0,20}\b(sin cargo|gratis)\b|^\s*@\w", I)
SIZE_WORDS = re.compile(r"\b(\d+([.,/]\d+)?|x|cm3|cc|ml|l|lts?|litros?|kg|kilos?|k|g|gs|grs?|gramos?|u|un|unid(ades)?|aprox)\b", I)
INFORMATIVE = re.compile(r"^\s*(consult\w*|ped\w+|avis\w*|hacemos|enviamos|entregamos|record\w*|tambi[eé]n|tenemos|trabajamos|cualquier|por favor|gracias|abrazo|saludos)\b", I)
INVOICE = re.compile(r"^\s*(\d{1,3})\s+(\d{2,6})\s+(.+?)\s+(\d{1,4})\s+([\d.,]+)\s+([\d.,]+)\s+([\d.,]+)\s*$")

# Price lists.
CODE = r"(?:[A-Za-z0-9]{1,4}-\d{3,6}|\d{3,7})"
SHORT_CODE = r"(?:[A-Za-z0-9]{1,4}-\d{3,6}|\d{1,7})"
LIST_PRICE = r"\d{1,3}(?:[.,]\d{3})*[.,]\d{2}|\d{4,7}[.,]\d{2}"
LIST_NUM = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
#: Grammars of list lines, tried in this order; groups: barcode, code, description, previous price, price.
GRAMMARS = (
    ("net", rf"^\s*(?:(\d{{8,14}})\s+)?(?:({CODE})\s+)?(.+?)\s+({LIST_PRICE})\s+\d+(?:[.,]\d+)?%(?:\s+\[?\d+(?:[.,]\d+)?%?\]?)*\s+({LIST_PRICE})\s*$"),
    ("percent", rf"^\s*()({CODE})\s+(.+?)\s+\$?\s*({LIST_NUM})\s+[+-]?\d+(?:[.,]\d+)?\s*%\s+\$?\s*({LIST_NUM})\s*$"),
    ("pesos", rf"^\s*()({SHORT_CODE})\s+([^$]+?)\s+\$()\s*([\d.,]+(?:\s+[\d.,]+){{0,2}})\s*$"),
    ("decimal", rf"^\s*()({CODE})\s+(.+?)()\s+(\d[\d.,]*[.,]\d{{2,3}})(?:\s+(?:\d\S*))?(?:\s+[A-Za-z/].*)?\s*$"),
)
LOOKS_LIKE_ARTICLE = r"[A-Za-z]{3,}.*\d+[.,]\d{2,3}\b"
NO_STOCK = r"(?i)\b(?:SIN\s+STOCK|S/\s*STOCK)\b"
PALLET = r"\s\d{2,3}\s+(?=\d+\s*x\s*\d)"
LIST_NOISE = (
    (r"(?i)\b(?:PR|OF)\b(?:\s*\d{1,2}/\d{1,2})?", " "),
    (r"(?i)^\s*Z{3}\s*", ""),
    (r"(?i)\b(?:NUEVO|SUBE|OFERTA?)\b\s*$", ""),
    (r"(?i)\(\s*\d*\s*U\s*x\s*B\s*\)|\b\d+\s*\(\s*UxB\s*\)", " "),
)
PRICE_IN_TEXT = r"\$\s*\d"
