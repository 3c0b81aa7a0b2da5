import __spark_entry__ as contract
from tradewind.schemas import BRONZE
from tradewind.sources import csv_files, star


def test_all_tables_are_landed(spark, small):
    found = {r["table_name"]: (r["rows"], r["rejected"]) for r in contract.queries()["ingest_csv_tables"](spark, small).collect()}
    assert found == {name: (table.count(), 0) for name, table in star.bronze(spark, small).items()}
    assert len(found) == 9


def test_rejected_rows_are_counted(spark, tmp_path):
    paths = {}
    for name, schema in BRONZE.items():
        paths[name] = f"{tmp_path}/{name}.csv"
        with open(paths[name], "w") as file:
            file.write(",".join(schema.fieldNames()) + "\n")
            if name == "sellers":
                file.write("s1,12,town,ST\ns2,no number,town,ST\n")
    csv_files.land(spark, paths, f"{tmp_path}/landed")
    found = {r["table_name"]: (r["rows"], r["rejected"]) for r in csv_files.landed_counts(spark, f"{tmp_path}/landed").collect()}
    assert found == {name: (1, 1) if name == "sellers" else (0, 0) for name in BRONZE}
