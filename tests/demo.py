"""A small pair of tables with seeded defects; results are worked out by hand."""

from tallymark.plans.suite import Suite
from tallymark.sources.connections import frames_connection
from tallymark.spec import RunOptions, mapping_from_dict

DEAL_COLUMNS = ("DEAL_ID FUND_CODE COMPANY PUBLIC_PRIVATE_FLAG ADJ_CODE LINE_TYPE FMV "
                "CASH_RECEIVED PERIOD").split()

SOURCE_DEALS = [
    ("D001", "F1", "Delta", "Public", "27", "Base", "1,250,000.00", "10,000", "2026Q1"),
    ("D001D", "F1", "Delta", "Public", "27", "Debt", "300,000.00", "0", "2026Q1"),
    ("D002", "F2", "Alpha", "Private", "3", "Base", "2,000", "5", "2026Q1"),
    ("D003", "F3", "Beta", "Private", "4", "Base", "", "7", "2026Q1"),
    ("D999", "F1", "Gamma", "Private", "5", "Base", "0", "0", "2026Q1"),
]
TARGET_DEALS = [
    ("D001", "F1", "Delta", "Public", "27", "Base", "1250000", "10000", "2026Q1", "SRC", "t1"),
    ("D001D", "F1", "Delta", "Public", "1", "Debt", "300000", "0", "2026Q1", "SRC", "t1"),
    ("D002", "F2", "Alpha", "Public", "3", "Base", "2000", "5", "2026Q1", "SRC", "t1"),
    ("D003", "F3", "Beta", "Private", "4", "Base", "0", "7", "2026Q1", "SRC", "t1"),
    ("D999", "F1", "Gamma", "Private", "5", "Base", "0", "0", "2026Q1", "SRC", "t1"),
]
FUNDS = [("F1", "Fund one"), ("F2", "Fund two"), ("F3", "Fund three")]

MAPPING = {
    "tables": [
        {"target_table": "DEAL", "source_object": "DEALS", "key_columns": ["DEAL_ID"],
         "later_field": 1,
         "options": {"group_by": ["FUND_CODE"], "null_not_zero": ["FMV"],
                     "completeness": [{"column": "PERIOD", "expected_values": ["2026Q1"]}]},
         "columns": [{"target_column": c, "source_column": c, "case_sensitive": True,
                      "nullable": c != "DEAL_ID",
                      "target_datatype": "DECIMAL" if c in ("FMV", "CASH_RECEIVED") else "VARCHAR"}
                     for c in DEAL_COLUMNS]},
        {"target_table": "FUND", "source_object": "FUNDS", "key_columns": "FUND_CODE",
         "options": {"lineage_columns": []},
         "columns": [{"target_column": c, "source_column": c, "target_datatype": "VARCHAR"}
                     for c in ("FUND_CODE", "FUND_NAME")]},
        {"source_object": "dropped: it names no target"},
    ],
    "business_rules": [
        {"rule_id": "BR001", "target_table": "DEAL", "rule_type": "value_equals", "severity": "P1",
         "filter": "COMPANY == 'Delta'", "params": {"column": "ADJ_CODE", "expected": 27}},
        {"rule_id": "BR002", "target_table": "DEAL", "rule_type": "conditional",
         "params": {"when": "COMPANY == 'Alpha'", "column": "PUBLIC_PRIVATE_FLAG",
                    "expected": "Private"}},
        {"rule_id": "BR003", "target_table": "DEAL", "rule_type": "must_not_exist",
         "filter": "COMPANY == 'Gamma'"},
        {"rule_id": "BR004", "target_table": "DEAL", "rule_type": "unique",
         "params": {"columns": ["DEAL_ID"]}},
        {"rule_id": "dropped", "target_table": "DEAL"},
    ],
    "ref_integrity": [{"child_table": "DEAL", "child_columns": "FUND_CODE",
                       "parent_table": "FUND", "parent_columns": "FUND_CODE"}],
}


def frames(spark):
    text = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    source = {"DEALS": text(SOURCE_DEALS, DEAL_COLUMNS),
              "FUNDS": text(FUNDS, ["FUND_CODE", "FUND_NAME"])}
    target = {"DEAL": text(TARGET_DEALS, [*DEAL_COLUMNS, "SOURCE_SYSTEM", "LOAD_TIMESTAMP"]),
              "FUND": text(FUNDS, ["FUND_CODE", "FUND_NAME"])}
    return source, target


def suite(spark, mapping=None, **kwargs):
    source, target = frames(spark)
    return Suite(spark, mapping_from_dict(mapping or MAPPING), frames_connection(target),
                 frames_connection(source), options=kwargs.pop("options", RunOptions()), **kwargs)
