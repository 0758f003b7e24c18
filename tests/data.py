"""Small invented records: the tools of a shared workshop with the jobs they were used for, and who made them.

Tools name their maker inside an object and the tools they were used with inside each job, by text keys.
"""

TOOLS_SPEC = {
    "resource_id": "tools",
    "fields": {
        "key": {"type": "long_string", "required": True},
        "label": {"type": "string", "required": True},
        "made": {"type": "object", "fields": {"by": {"type": "long_string"}, "year": {"type": "integer"}}},
        "weight": {"type": "number"},
        "lent": {"type": "boolean"},
        "jobs": {
            "type": "object",
            "collection": True,
            "fields": {"what": {"type": "string"}, "hours": {"type": "number"}, "along": {"type": "long_string", "collection": True}},
        },
        "_maker": {"virtual": True, "plugin": "link", "params": {"resource": "makers", "target": "key"}, "field_params": {"id": "made.by"}},
    },
    "sort": "label",
    "id": "key",
}
MAKERS_SPEC = {
    "resource_id": "makers",
    "fields": {
        "key": {"type": "long_string", "required": True},
        "label": {"type": "string", "required": True},
        "towns": {"type": "string", "collection": True},
        "lent": {"type": "integer"},
    },
    "sort": "label",
    "id": "key",
}
TOOLS = [
    {"key": "saw", "label": "Fine saw", "made": {"by": "holm", "year": 1998}, "weight": 0.4, "lent": True, "jobs": [{"what": "Cut joints", "hours": 2.5, "along": ["vice", "plane"]}, {"what": "Trim", "hours": 1.0}]},
    {"key": "plane", "label": "Block plane", "made": {"by": "holm"}, "weight": 0.75, "jobs": [{"what": "Trim edges", "hours": 0.5, "along": ["vice"]}]},
    {"key": "vice", "label": "Bench vice", "made": {"by": "öberg", "year": 1971}, "weight": 11.0, "lent": False},
    {"key": "drill", "label": "Hand-drill 40", "made": {"year": 2003}, "weight": 1.25, "lent": True, "jobs": [{"what": "Bore", "along": ["lost"]}]},
    {"key": "mallet", "label": "Mallet", "weight": 0.75, "jobs": []},
    {"key": "gauge", "label": "Ångström gauge", "made": {"by": "nobody", "year": 2003}, "jobs": [{"what": "Mark joints", "hours": 0.25, "along": ["saw", "mallet", "saw"]}]},
    {"key": "rule", "label": "Folding rule", "lent": False, "made": {"by": "öberg"}},
]
MAKERS = [
    {"key": "holm", "label": "Holm & söner", "towns": ["Ängsö", "Lund"], "lent": 12},
    {"key": "öberg", "label": "Öbergs smedja", "towns": ["Lund"]},
    {"key": "kil", "label": "Kil verktyg", "lent": 3},
]


def entries(spark, records, spec, id="code"):
    import json

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(str(r.get(id, i)), json.dumps(r)) for i, r in enumerate(records)], "id string, j string")
    return rows.select(
        F.lit(spec.name).alias("resource"),
        "id",
        F.lit(1).alias("version"),
        F.lit(1.0).alias("last_modified"),
        F.lit("user1").alias("last_modified_by"),
        F.from_json("j", spec.body_type()).alias("entry"),
    )
