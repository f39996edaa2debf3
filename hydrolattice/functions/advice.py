"""Irrigation rules, their texts, and map-layer properties."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CLASS_COLOURS, CLASS_LABELS, LANGUAGES
from .numeric import as_col, round_even
from .water import stress_label

# Rule number -> (priority, colour), and the rule limits.
OUTCOMES = {1: (1, "#dc3545"), 2: (2, "#ffc107"), 3: (3, "#28a745"), 4: (2, "#fd7e14"), 5: (3, "#28a745")}
HOT_C, THIRSTY_MM, DRY_NDWI, WET_MM = 33.0, 35.0, 0.02, 5.0

FIELDS = ("urgency", "title", "recommendation", "actionable_steps")

# Texts per rule and language: urgency, title, recommendation, steps. {temp}, {ndwi} and {rain} are filled in.
TEXTS = {
    1: {
        "en": ("1-2 days", "High stress, urgent",
               "Class HIGH at {temp}°C with a leaf water index of {ndwi}: heat, demand or dry leaves are past their limit.",
               ["Put this cell first on the watering list", "Compare tomorrow's temperature with 33°C"]),
        "mr": ("१-२ दिवस", "जास्त ताण, तातडीचे",
               "वर्ग HIGH; तापमान {temp}°C, पान जल निर्देशांक {ndwi}: उष्णता, मागणी किंवा कोरडी पाने मर्यादेबाहेर आहेत.",
               ["ही जागा पाणी यादीत पहिली ठेवा", "उद्याचे तापमान ३३°C शी ताडून पाहा"]),
        "hi": ("१-२ दिन", "अधिक तनाव, तत्काल",
               "वर्ग HIGH; तापमान {temp}°C, पत्ती जल सूचकांक {ndwi}: गर्मी, माँग या सूखी पत्तियाँ सीमा से बाहर हैं।",
               ["इस खंड को सिंचाई सूची में पहले रखें", "कल के तापमान की ३३°C से तुलना करें"]),
    },
    2: {
        "en": ("3-5 days", "High stress, limits kept",
               "Class HIGH, but {temp}°C, the demand and the leaf water index are inside their limits: there is time to schedule.",
               ["Book water for this cell this week", "Score it again after the next scene"]),
        "mr": ("३-५ दिवस", "जास्त ताण, मर्यादेत",
               "वर्ग HIGH, पण {temp}°C, मागणी आणि पान जल निर्देशांक मर्यादेत आहेत: वेळ ठरवता येईल.",
               ["या आठवड्यात या जागेसाठी पाणी ठरवा", "पुढील प्रतिमेनंतर पुन्हा मोजा"]),
        "hi": ("३-५ दिन", "अधिक तनाव, सीमा में",
               "वर्ग HIGH, पर {temp}°C, माँग और पत्ती जल सूचकांक सीमा में हैं: समय तय किया जा सकता है।",
               ["इस सप्ताह इस खंड के लिए पानी तय करें", "अगली छवि के बाद फिर आँकें"]),
    },
    3: {
        "en": ("Watch", "Rain is holding", "{rain} mm of recent rain still feeds the soil. Look again in about five days.",
               ["Check soil moisture before watering"]),
        "mr": ("लक्ष ठेवा", "पावसाचा ओलावा आहे", "अलीकडील {rain} मिमी पावसाचा ओलावा शिल्लक आहे. पाच दिवसांनी पुन्हा पाहा.",
               ["पाणी देण्यापूर्वी ओलावा तपासा"]),
        "hi": ("नज़र रखें", "बारिश की नमी है", "हाल की {rain} मिमी बारिश की नमी बाकी है। पाँच दिन बाद फिर देखें।",
               ["पानी देने से पहले नमी जाँचें"]),
    },
    4: {
        "en": ("Within 3-5 days", "Irrigation is coming up", "Leaf water is falling (index {ndwi}). Water within five days.",
               ["Look at moisture near the roots", "Agree on a release with the water users' group"]),
        "mr": ("३-५ दिवसांत", "लवकरच सिंचन लागेल", "पानातील पाणी घटत आहे (निर्देशांक {ndwi}). पाच दिवसांत पाणी द्या.",
               ["मुळांजवळचा ओलावा पाहा", "पाणी वापर गटाशी वेळ ठरवा"]),
        "hi": ("३-५ दिन में", "जल्द सिंचाई चाहिए", "पत्ती का पानी घट रहा है (सूचकांक {ndwi})। पाँच दिन में पानी दें।",
               ["जड़ों के पास नमी देखें", "जल उपभोक्ता समूह से समय तय करें"]),
    },
    5: {
        "en": ("No action", "Enough water", "The crop holds enough water (index {ndwi}). Keep the canal share for later.",
               ["Go on with normal field visits"]),
        "mr": ("कृती नको", "पुरेसे पाणी", "पिकात पुरेसे पाणी आहे (निर्देशांक {ndwi}). कालव्याचा वाटा नंतरसाठी ठेवा.",
               ["नेहमीप्रमाणे शेताची पाहणी करा"]),
        "hi": ("कुछ न करें", "पर्याप्त पानी", "फसल में पर्याप्त पानी है (सूचकांक {ndwi})। नहर का हिस्सा बाद के लिए रखें।",
               ["सामान्य निगरानी जारी रखें"]),
    },
}


def rule(stress, ndwi, temp, et0, rain) -> Column:
    """Number of the rule that applies."""
    stress = as_col(stress)
    urgent = (
        F.coalesce(as_col(temp) >= HOT_C, F.lit(False))
        | F.coalesce(as_col(et0) >= THIRSTY_MM, F.lit(False))
        | F.coalesce(as_col(ndwi) < DRY_NDWI, F.lit(False))
    )
    return (
        F.when((stress == 2) & urgent, 1)
        .when(stress == 2, 2)
        .when((stress == 1) & (as_col(rain) > WET_MM), 3)
        .when(stress == 1, 4)
        .otherwise(5)
    )


def _by_rule(rule_no: Column, values: dict[int, object]) -> Column:
    out = F.lit(None)
    for number, value in values.items():
        branch = value if isinstance(value, Column) else F.lit(value)
        out = F.when(rule_no == number, branch) if number == 1 else out.when(rule_no == number, branch)
    return out


def priority(rule_no) -> Column:
    return _by_rule(as_col(rule_no), {n: p for n, (p, _) in OUTCOMES.items()})


def colour(rule_no) -> Column:
    return _by_rule(as_col(rule_no), {n: c for n, (_, c) in OUTCOMES.items()})


def _template(rule_no: Column, language: Column) -> Column:
    """Entry of one rule and language in a constant list, which Spark reads once while it plans."""
    entries = [dict(zip(FIELDS, TEXTS[n][lang])) for n in TEXTS for lang in LANGUAGES]
    listed = F.from_json(
        F.lit(json.dumps(entries, ensure_ascii=False)),
        "array<struct<urgency:string,title:string,recommendation:string,actionable_steps:array<string>>>",
    )
    place = F.array_position(F.array(*map(F.lit, LANGUAGES)), language).cast("int") - 1
    return F.get(listed, (rule_no - 1) * len(LANGUAGES) + place)


def _told(entry: Column, ndwi, temp, rain) -> Column:
    """The entry's four fields with the numbers filled in."""
    message = entry["recommendation"]
    for name, fmt, value, digits in (("{temp}", "%.1f", temp, 1), ("{ndwi}", "%.2f", ndwi, 2), ("{rain}", "%.1f", rain, 1)):
        message = F.replace(message, F.lit(name), F.coalesce(F.format_string(fmt, round_even(value, digits)), F.lit("")))
    return F.struct(*[(message if f == "recommendation" else entry[f]).alias(f) for f in FIELDS])


def _heads(stress, confidence, number: Column) -> list[Column]:
    level = priority(number)
    return [
        as_col(stress).cast("int").alias("stress_class_code"),
        stress_label(stress).alias("stress_class_label"),
        round_even(as_col(confidence) * 100, 1).alias("confidence_pct"),
        level.alias("priority"),
        F.concat(F.lit("PRIORITY "), level.cast("string")).alias("priority_label"),
        colour(number).alias("color"),
    ]


def _inputs(temp, et0, rain) -> list[Column]:
    return [F.lit(d) if v is None else as_col(v) for v, d in ((temp, 32.0), (et0, 35.0), (rain, 0.0))]


def known_language(language) -> Column:
    """A supported language code in lower case; anything else is English."""
    wanted = F.lower(language if isinstance(language, Column) else F.lit(language))
    return F.when(wanted.isin(*LANGUAGES), wanted).otherwise(F.lit("en"))


def advisory(stress, confidence, ndwi, temp=None, et0=None, rain=None) -> Column:
    """The whole advisory as a struct, with ``texts`` keyed by language."""
    temp, et0, rain = _inputs(temp, et0, rain)
    number = rule(stress, ndwi, temp, et0, rain)
    texts = F.create_map(*[
        part for lang in LANGUAGES for part in (F.lit(lang), _told(_template(number, F.lit(lang)), ndwi, temp, rain))
    ])
    return F.struct(*_heads(stress, confidence, number), texts.alias("texts"))


def advisory_in(language, stress, confidence, ndwi, temp=None, et0=None, rain=None) -> Column:
    """The advisory in one language, which may differ by row; no other language's text is made."""
    temp, et0, rain = _inputs(temp, et0, rain)
    number = rule(stress, ndwi, temp, et0, rain)
    known = known_language(language)
    told = _told(_template(number, known), ndwi, temp, rain)
    return F.struct(*_heads(stress, confidence, number), *[told[f].alias(f) for f in FIELDS], known.alias("language"))


def localised(advice, language) -> Column:
    """The advisory in one language; an unknown language falls back to English."""
    advice = as_col(advice)
    known = known_language(language)
    chosen = F.try_element_at(advice["texts"], known)
    heads = ("stress_class_code", "stress_class_label", "confidence_pct", "priority", "priority_label", "color")
    return F.struct(*[advice[h].alias(h) for h in heads], *[chosen[f].alias(f) for f in FIELDS], known.alias("language"))


def stress_properties(cell, when, stress, confidence, ndvi, ndwi) -> Column:
    """Properties of one cell on the stress layer."""
    label = stress_label(stress)
    paint = F.lit(None)
    for i, name in enumerate(CLASS_LABELS):
        paint = F.when(label == name, CLASS_COLOURS[name]) if i == 0 else paint.when(label == name, CLASS_COLOURS[name])
    return F.struct(
        as_col(cell).alias("cell_id"), as_col(when).cast("string").alias("date"), label.alias("stress_class"),
        as_col(confidence).alias("confidence"), paint.alias("fill_color"),
        round_even(ndvi, 3).alias("ndvi"), round_even(ndwi, 3).alias("ndwi"),
    )


def irrigation_properties(cell, when, stress, confidence, ndvi, ndwi, temp, et0, rain) -> Column:
    """Properties of one cell on the irrigation layer, with a flat field per text and language."""
    number = rule(stress, ndwi, temp, et0, rain)
    level = priority(number)
    told = {lang: _told(_template(number, F.lit(lang)), ndwi, temp, rain) for lang in LANGUAGES}
    return F.struct(
        as_col(cell).alias("cell_id"), as_col(when).cast("string").alias("date"), level.alias("priority"),
        F.concat(F.lit("Priority "), level.cast("string")).alias("priority_label"),
        colour(number).alias("fill_color"), as_col(confidence).alias("confidence"),
        round_even(ndvi, 3).alias("ndvi"), round_even(ndwi, 3).alias("ndwi"),
        *[told[lang][f].alias(f"{f}_{lang}") for f in FIELDS for lang in LANGUAGES],
    )
