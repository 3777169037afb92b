"""Term lists of the economic-news domain; every operator takes its list as a parameter with these as defaults.

All values here are fixed: results depend on exactly these terms, weights and their order.
"""

# Institutions and how they are written.
ENTITIES = {
    "BCB": ["bcb", "banco central de bolivia", "banco central"],
    "ASFI": ["asfi", "autoridad de supervisión del sistema financiero"],
    "INE": ["ine", "instituto nacional de estadística", "instituto nacional de estadistica"],
    "YPFB": ["ypfb", "yacimientos petrolíferos fiscales bolivianos", "yacimientos petroliferos fiscales bolivianos"],
    "MEFP": [
        "ministerio de economía", "ministerio de economia", "ministerio de economía y finanzas públicas",
        "ministerio de economia y finanzas publicas", "mefp",
    ],
    "SIN": ["sin", "servicio de impuestos nacionales"],
    "Aduana Nacional": ["aduana nacional", "aduana"],
    "IBCE": ["ibce", "instituto boliviano de comercio exterior"],
    "FMI": ["fmi", "fondo monetario internacional"],
    "BID": ["bid", "banco interamericano de desarrollo"],
    "CAF": ["caf", "banco de desarrollo de américa latina", "banco de desarrollo de america latina"],
    "Banco Mundial": ["banco mundial"],
}
#: The entity whose acronym is also a common word: it counts only in capitals or by its full name.
CAPITALS_ONLY = "SIN"

# Economic indicators and how they are written.
INDICATORS = {
    "inflación": ["inflación", "inflacion", "ipc", "índice de precios al consumidor", "indice de precios al consumidor"],
    "tipo de cambio": ["tipo de cambio", "dólar", "dolar", "divisas", "mercado paralelo", "cotización del dólar", "cotizacion del dolar"],
    "reservas internacionales": ["reservas internacionales", "reservas netas", "rin", "reservas"],
    "combustibles": ["combustible", "combustibles", "diésel", "diesel", "gasolina", "gas licuado", "glp"],
    "deuda pública": ["deuda pública", "deuda publica", "endeudamiento", "deuda externa", "deuda interna"],
    "déficit fiscal": ["déficit fiscal", "deficit fiscal", "déficit", "deficit", "gasto público", "gasto publico"],
    "producto interno bruto": ["producto interno bruto", "pib", "crecimiento económico", "crecimiento economico"],
    "exportaciones": ["exportaciones", "exportación", "exportacion", "ventas externas"],
    "importaciones": ["importaciones", "importación", "importacion", "compras externas"],
    "balanza comercial": ["balanza comercial", "superávit comercial", "superavit comercial", "déficit comercial", "deficit comercial"],
    "litio": ["litio", "carbonato de litio", "ylb", "yacimientos de litio bolivianos"],
    "hidrocarburos": ["hidrocarburos", "gas natural", "petróleo", "petroleo", "producción de gas", "produccion de gas"],
    "empleo": ["empleo", "desempleo", "ocupación", "ocupacion", "mercado laboral"],
    "salarios": ["salario", "salarios", "salario mínimo", "salario minimo", "incremento salarial"],
    "sistema financiero": ["sistema financiero", "banca", "bancos", "crédito", "credito", "cartera", "depósitos", "depositos", "liquidez"],
}

# Terms of risk and of relief with their weights.
RISK = {
    "crisis": 8, "escasez": 8, "desabastecimiento": 9, "déficit": 6, "deficit": 6, "caída": 5, "caida": 5, "inflación": 5,
    "inflacion": 5, "devaluación": 8, "devaluacion": 8, "incertidumbre": 5, "bloqueo": 6, "conflicto": 5, "pérdida": 5,
    "perdida": 5, "recesión": 8, "recesion": 8, "contracción": 7, "contraccion": 7, "quiebra": 9, "riesgo": 4, "presión": 4,
    "presion": 4, "deterioro": 6, "emergencia": 7, "insuficiente": 4, "falta": 4, "demora": 3,
}
RELIEF = {
    "crecimiento": 4, "superávit": 5, "superavit": 5, "mejora": 4, "recuperación": 5, "recuperacion": 5,
    "aumento de exportaciones": 5, "estabilidad": 4, "fortalecimiento": 4, "récord": 5, "record": 5, "expansión": 5, "expansion": 5,
}

# Terms of optimism with their weights.
OPTIMISM = {
    "inversión": 4, "inversion": 4, "crecimiento": 4, "recuperación": 5, "recuperacion": 5, "reactivación": 5, "reactivacion": 5,
    "mejora": 3, "mejoró": 3, "mejoro": 3, "empleo": 3, "exportaciones": 3, "superávit": 5, "superavit": 5, "financiamiento": 3,
    "cooperación": 2, "cooperacion": 2, "desarrollo": 2, "producción": 3, "produccion": 3, "industrialización": 4,
    "industrializacion": 4, "competitividad": 3, "estabilidad": 4, "abastecimiento": 2, "garantiza": 3, "fortalece": 3,
    "impulsa": 3, "incremento": 2, "aumento de ingresos": 4, "nuevos empleos": 5, "capital": 2,
}

# Terms of economic relevance when cleaning a corpus, and when collecting pages.
CLEAN_TERMS = [
    "inflación", "inflacion", "dólar", "dolar", "divisas", "tipo de cambio", "reservas", "combustible", "combustibles", "diésel", "diesel",
    "gasolina", "petróleo", "petroleo", "gas natural", "litio", "exportaciones", "importaciones", "comercio exterior", "balanza comercial",
    "déficit", "deficit", "superávit", "superavit", "pib", "crecimiento", "economía", "economia", "empleo", "desempleo", "salario",
    "crédito", "credito", "banca", "financiero", "deuda", "presupuesto", "inversión", "inversion", "producción", "produccion", "ypfb",
    "bcb", "ine", "asfi", "mefp",
]
COLLECT_TERMS = [
    "economía", "economia", "económico", "economico", "inflación", "inflacion", "ipc", "precio", "precios", "dólar", "dolar", "divisas",
    "tipo de cambio", "reservas", "exportación", "exportacion", "exportaciones", "importación", "importacion", "importaciones",
    "balanza comercial", "déficit", "deficit", "superávit", "superavit", "pib", "crecimiento", "empleo", "desempleo", "salario", "crédito",
    "credito", "banca", "financiero", "financiera", "presupuesto", "deuda", "inversión", "inversion", "hidrocarburos", "gas", "petróleo",
    "petroleo", "combustible", "combustibles", "diésel", "diesel", "gasolina", "litio", "producción", "produccion", "industria",
    "agricultura", "tributario", "impuestos", "recaudación", "recaudacion", "aduana", "asfi", "bcb", "ine", "ypfb", "mefp",
]

# Titles that aren't news when cleaning, exactly and by pattern.
EXCLUDED_TITLES = [
    "leyes", "normativa", "valores y principios", "oficinas departamentales", "introducción", "introduccion",
    "manual de procesos y procedimientos", "programa fiscal financiero", "gráficos ipc", "graficos ipc",
    "sistema integral de pensiones inversiones", "modelos referenciales eeff", "sitio oficial del estado plurinacional de bolivia",
]
EXCLUDED_PATTERNS = [
    r"\bmanual\b", r"\bnormativa\b", r"\bley(?:es)?\b", r"\breglamento\b", r"\bprocedimiento(?:s)?\b", r"\borganigrama\b", r"\bmisión\b",
    r"\bmision\b", r"\bvisión\b", r"\bvision\b", r"\bvalores institucionales\b", r"\btransparencia\b", r"\brendición de cuentas\b",
    r"\brendicion de cuentas\b", r"\bconvocatoria\b", r"\bcontrataciones\b", r"\boficinas departamentales\b", r"\bdirectorio institucional\b",
]

# Titles of index pages when collecting, exactly and by pattern.
GENERIC_TITLES = [
    "leyes", "directorio", "ejecutivos", "presentaciones del presidente", "encaje legal", "posición de cambios", "posicion de cambios",
    "sector externo", "sector monetario", "sector precios", "sitio oficial del estado plurinacional de bolivia", "normativa",
    "manual de procesos y procedimientos", "valores y principios", "oficinas departamentales", "introducción", "introduccion",
]
GENERIC_PATTERNS = [
    r"^leyes(?:\s*\|.*)?$", r"^directorio(?:\s*\|.*)?$", r"^ejecutivos(?:\s*\|.*)?$", r"^sector\s+(externo|monetario|precios)$",
    r"^sitio oficial", r"^normativa(?:\s*\|.*)?$", r"^manual\b", r"^oficinas departamentales$",
]

# Stop words, negators and topic-model stop words.
NEGATORS = ["no", "nunca", "jamás", "tampoco", "ni", "sin"]
STOPWORDS = ["dijo", "señaló", "indicó", "informó", "según", "también", "tras", "durante"]
TOPIC_STOPWORDS = STOPWORDS + (
    "a al algo algunas algunos ante antes aquel aquella aquellas aquello aquellos aquí así aun aunque bajo bien cada casi como con contra "
    "cual cuando de del desde donde dos durante e el ella ellas ello ellos en entre era eran es esa esas ese eso esos esta estaba están "
    "estar estas este esto estos fue fueron ha han hasta hay la las le les lo los más me menos mi mientras muy ni no nos o otra otras otro "
    "otros para pero poco por porque que qué quien quienes se sea según ser si sin sobre son su sus también tan tanto te tiene tienen todo "
    "todos tras tu un una uno unos usted ya y web teléfono telefono sede social empleados facturación facturacion domicilio contacto correo "
    "página pagina 2023 2024 2025 2026"
).split()
