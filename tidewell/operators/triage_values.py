"""Fixed values of the clinical triage: word lists, patterns and limits.

These decide which sentences raise a flag, so they are the same wherever this triage is done. Patterns are for normalised
text (lower case, no accents, numbers in digits); white space in them also stands for the commas of a pause.
"""

# Fixed values, in their natural order.
UNITS = {"cero": 0, "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
TENS = {"veinte": 20, "treinta": 30, "cuarenta": 40}
FILLERS = r"\b(?:e+h+|a+h+|em|mm+|umm+|o\s+sea|osea|digamos|pues)\b"

NEGATORS = r"\b(?:no|ni|nada\s+de|ning[uú]n|ninguna|ninguno|sin|tampoco|jam[aá]s|nunca|que\s+va)\b"
DOUBT_AFTER_NO = r"\s+s[eé]\s+(?:si|que|qu[eé]|cuant|cuand|como|bien|exact|muy|la\b)"
SYMPTOM_WITHOUT = r"sin\s+(?:parar|cesar|aire|descanso|control|freno)\b"
CLAUSE_END = r"[,;.!?¿¡]|\bpero\b|\baunque\b|\bsino\b"
NEGATION_WORDS = 4

GAP = r"(?:\w+\s+){0,3}?"
# code, urgency, reason, protocol question, pattern
RULES = [
    (
        "sangrado_activo", "urgente", "sangrado activo en la herida", "sangrado activo de la herida quirurgica que hacer",
        r"(?:no\s+para\s+de\s+sangrar|no\s+deja\s+de\s+sangrar|hemorragia|"
        r"(?:sangra|sangrando|sangrado|sangre)\s+(?:\w+\s+){0,2}?(?:mucho|much[ao]|bastante|abundante|a\s+chorros|sin\s+parar)|"
        rf"(?:mucha|bastante|demasiada)\s+sangre|empapad[ao]s?\s+{GAP}(?:de\s+)?(?:sangre|gasa|aposito|venda)|"
        rf"empapando\s+{GAP}(?:gasa|aposito|venda|vendaje)|chorro\s+de\s+sangre|sangre\s+a\s+chorros)",
    ),
    (
        "sangrado", "urgente", "sangrado de la herida", "sangrado de la herida quirurgica que hacer",
        rf"(?:me\s+{GAP}(?:sale|salio|esta\s+saliendo|sali[oa])\s+{GAP}sangre|"
        rf"(?:la\s+)?(?:herida|cicatriz|incision)\s+{GAP}(?:sangra|esta\s+sangrando|sangro)|"
        r"esta\s+sangrando|estoy\s+sangrando|sangrando\s+por\s+(?:la\s+)?herida)",
    ),
    (
        "dehiscencia", "urgente", "la herida se ha abierto (dehiscencia)", "dehiscencia herida abierta puntos sueltos que hacer",
        rf"(?:dehiscencia|se\s+{GAP}(?:abrio|ha\s+abierto|abrieron|han\s+abierto|despego|solto|soltaron|salieron|salio|salido|reventaron|revento|rompio)\s+{GAP}"
        r"(?:la\s+|el\s+|los\s+|las\s+)?(?:herida|cicatriz|incision|punto|puntos|grapa|grapas|sutura)|"
        rf"(?:herida|cicatriz|incision)\s+{GAP}(?:esta\s+|se\s+ve\s+)?abiert[ao]|se\s+me\s+(?:ve|ven)\s+(?:por\s+dentro|la\s+carne|las\s+tripas))",
    ),
    (
        "dolor_toracico", "urgente", "dolor torácico", "dolor toracico postoperatorio urgencia que hacer",
        rf"(?:dolor\s+toracico|(?:dolor|opresion|presion|peso|aprieta|ardor)\s+{GAP}(?:en\s+)?(?:el\s+)?pecho|"
        rf"me\s+duele\s+{GAP}(?:el\s+)?pecho|(?:pecho|torax)\s+(?:me\s+)?(?:duele|aprieta)|me\s+aprieta\s+el\s+pecho)",
    ),
    (
        "disnea", "urgente", "dificultad respiratoria", "dificultad para respirar disnea postoperatoria urgencia",
        rf"(?:disnea|no\s+puedo\s+respirar|no\s+consigo\s+respirar|me\s+(?:falta|faltaba|esta\s+faltando)\s+{GAP}(?:el\s+)?aire|"
        rf"me\s+(?:cuesta|costaba)\s+{GAP}respirar|me\s+ahogo|me\s+estoy\s+ahogando|sensacion\s+de\s+ahogo|dificultad\s+(?:para|al)\s+respirar|"
        r"me\s+quedo\s+sin\s+aire|se\s+me\s+fue\s+el\s+aliento|fatiga\s+en\s+el\s+pecho|asfixia|me\s+siento\s+asfixiad[ao]|(?:respiro|respirar)\s+con\s+dificultad)",
    ),
    (
        "signos_infeccion", "prioritaria", "signos de infección en la herida", "signos de infeccion de la herida quirurgica pus enrojecimiento",
        r"(?:\bpus\b|purulent[ao]|supura|supurando|chichon\s+con\s+pus|broto\s+un\s+chichon|"
        rf"(?:sale|saliendo|salir)\s+{GAP}(?:un\s+|una\s+)?(?:liquido|material|secrecion)\s+(?:\w+\s+){{0,2}}?(?:amarill[ao]|verd[eo]s?|verdos[ao]|con\s+mal\s+olor|maloliente)|"
        r"(?:liquido|material|secrecion)\s+(?:amarill[ao]|verdos[ao]|purulent[ao])|(?:huele\s+mal|mal\s+olor|olor\s+feo|olor\s+fetido))",
    ),
    (
        "signos_infeccion", "prioritaria", "herida enrojecida con signos inflamatorios", "signos de infeccion de la herida quirurgica enrojecimiento calor",
        rf"(?:(?:roj[ao]|enrojecid[ao]|colorad[ao])\s+{GAP}(?:y\s+)?(?:caliente|hinchad[ao]|inflamad[ao]|dura|endurecid[ao])|"
        rf"(?:caliente|hinchad[ao]|inflamad[ao])\s+{GAP}(?:y\s+)?(?:roj[ao]|enrojecid[ao])|"
        r"(?:cada\s+vez\s+mas|mas)\s+roj[ao]\s+(?:e\s+|y\s+)?(?:hinchad[ao]|inflamad[ao]|caliente))",
    ),
    (
        "fiebre_referida", "prioritaria", "fiebre alta referida sin termómetro", "fiebre despues de la cirugia cuando consultar",
        r"(?:(?:mucha|much[ií]sima|bastante|alt[ai]sima)\s+fiebre|fiebre\s+(?:muy\s+)?(?:alta|altisima|fuerte)|"
        r"(?:ardiendo|hirviendo)\s+(?:de\s+fiebre|en\s+fiebre|en\s+calentura)|volando\s+en\s+fiebre|con\s+templorina|tengo\s+calentura|estoy\s+ardiendo|fiebrones?)",
    ),
]
FAMILY = {"fiebre_alta": "fiebre", "fiebre_referida": "fiebre", "sangrado_activo": "sangrado", "sangrado": "sangrado"}
WEIGHT = {"urgente": 3, "prioritaria": 2, "rutina": 1}
ATTENUATORS = r"\b(?:un\s+poquit[oa]|un\s+poco|poquit[oa]|manchit[ao]|gotit?as?|unas?\s+gotas?|muy\s+poc[oa]|casi\s+nada|apenas|leve|minim[ao]|puntit[oa]|una\s+mancha)\b"

FEVER = 38.5
FEVER_RANGE = (35.0, 43.0)
FEVER_QUESTION = "fiebre alta despues de la cirugia que hacer urgencia"
FEVER_CUES = r"\b(?:fiebre|febril|febricula|calentura|temperatura|termometro|grados|decimas|destemplad[ao]|tirit(?:o|ando|ona)|escalofrios)\b"
OTHER_UNITS = r"\s*(?:anos|ano|kilos|kilo|kg|mg|miligramos|gramos|g|ml|horas|hora|dias|dia|minutos|semanas|veces|puntos|pastillas|comprimidos|por\s+ciento|%)\b"
FEVER_NUMBER = r"\b(\d{2}(?:\.\d)?)\b"
CUE_CHARS, EXCERPT_CHARS = 45, 30
