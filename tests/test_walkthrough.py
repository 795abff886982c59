"""From raw files to every report, the way a user strings the pieces together."""

import json
import random

from pyspark.sql import functions as F

from conftest import item
from shoplens import plans, sources, streaming
from shoplens.operators import duplicate_keys, table_counts, unparsed_timestamps
from shoplens.session import tune
from shoplens.sources import schemas


def make_raw(folder):
    rng = random.Random(4)
    products = [
        {
            "product_id": f"prod_{i:05d}",
            "name": f"Product {i}",
            "category_id": f"cat_{i % 5:03d}",
            "base_price": round(rng.uniform(1, 90), 2),
            "price_history": [{"price": 1.25, "date": "2025-01-01"}],
        }
        for i in range(40)
    ]
    categories = [
        {"category_id": f"cat_{i:03d}", "name": f"Category {i}", "subcategories": []} for i in range(5)
    ]
    users = [{"user_id": f"user_{i:06d}", "geo_data": {"city": "Ulm"}} for i in range(30)]
    transactions = []
    for i in range(300):
        items = [
            item(p["product_id"], rng.randint(1, 4), p["base_price"])
            for p in rng.sample(products, rng.randint(1, 5))
        ]
        subtotal = round(sum(x["subtotal"] for x in items), 2)
        discount = round(subtotal * 0.1, 2) if i % 3 == 0 else 0.0
        transactions.append(
            {
                "transaction_id": f"txn_{i:012x}",
                "session_id": None,
                "user_id": f"user_{min(rng.randrange(30), rng.randrange(30)):06d}",
                "timestamp": f"2025-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d}T12:00:{i % 60:02d}",
                "items": items,
                "subtotal": subtotal,
                "discount": discount,
                "total": round(subtotal - discount, 2),
                "status": "completed",
            }
        )
    for name, rows in {
        "products": products,
        "categories": categories,
        "users": users,
        "transactions": transactions,
    }.items():
        (folder / f"{name}.json").write_text(json.dumps(rows, indent=2))
    (folder / "sessions").mkdir()
    sessions = [
        {
            "session_id": f"sess_{i}",
            "user_id": f"user_{i % 30:06d}",
            "start_time": f"2025-01-01T00:{i % 60:02d}:00",
            "device_profile": {"type": "mobile" if i % 3 else "desktop"},
            "conversion_status": "converted" if i % 5 == 0 else "browsed",
        }
        for i in range(120)
    ]
    for i in range(2):
        chunk = sessions[i * 60 : (i + 1) * 60]
        (folder / "sessions" / f"sessions_{i}.json").write_text(json.dumps(chunk))
    return transactions


def test_everything_from_raw_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    documents = make_raw(raw)
    tune(spark, str(raw))
    tables = {
        name: sources.load_collection(
            spark, name, str(raw / f"{name}.json"), str(tmp_path / "tables" / name)
        )
        for name in schemas.COLLECTIONS
    }
    transactions, products = tables["transactions"], tables["products"]
    assert {tuple(r) for r in table_counts(tables).collect()} == {
        ("users", 30),
        ("categories", 5),
        ("products", 40),
        ("transactions", 300),
    }
    for name, key in schemas.KEYS.items():
        assert duplicate_keys(tables[name], key).isEmpty()
    assert unparsed_timestamps(transactions, ["timestamp"]).first()[0] == 0

    sources.write_line_items(plans.line_items(transactions, products), str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    assert items.count() == sum(len(d["items"]) for d in documents)

    pairs = plans.also_bought(items, k=10)
    out = tmp_path / "also_bought"
    assert sources.write_result(pairs, str(out), [F.col("co_count").desc()], single_file=True)
    back = sources.read_result_csv(
        spark, str(out), ["product_a_name", "product_b_name", "co_count"], ["co_count"]
    )
    totals = plans.copurchase_totals(back)
    assert totals.agg(F.sum("co_purchases")).first()[0] == 2 * pairs.agg(F.sum("co_count")).first()[0]

    cents = sum(round(d["total"] * 100) for d in documents)
    value = plans.customer_value(transactions, ordered=False)
    assert round(value.agg(F.sum("total_revenue")).first()[0] * 100) == cents
    from_items = plans.customer_value_from_items(items).agg(F.sum("clv")).first()[0]
    assert round(from_items * 100) == sum(round(d["subtotal"] * 100) for d in documents)

    revenue = plans.revenue_by_category(transactions, products, categories=tables["categories"])
    assert revenue.columns == ["category_id", "year_month", "revenue", "category_name"]
    assert revenue.count() == 30 and plans.category_timeline(revenue).count() == 30
    spring = plans.revenue_by_category(items, products, "2025-03-01", "2025-05-01")
    wanted = revenue.where("year_month in ('2025-03', '2025-04')").agg(F.sum("revenue")).first()[0]
    assert round(spring.agg(F.sum("revenue")).first()[0], 2) == round(wanted, 2)

    best = plans.top_products(transactions, products, limit=5).collect()
    assert len(best) == 5 and best[0].total_revenue >= best[4].total_revenue
    assert plans.user_segmentation(transactions, boundaries=[0, 5, 20]).agg(F.sum("customers")).first()[0] == value.count()
    assert plans.cohort_retention(transactions).where("cohort_index = 0").count() >= 1
    segments = plans.customer_segments(value)
    assert sum(sum(r[1:]) for r in segments.collect()) == value.count()
    assert plans.value_distribution_box(value).count() == 3
    assert plans.customer_scatter(value).count() == value.count()

    loaded = streaming.ingest_sessions(
        spark, str(raw / "sessions"), str(tmp_path / "loaded"), str(tmp_path / "progress")
    )
    current = plans.current_sessions(loaded)
    # Sessions sixty apart share user and start; the second chunk wins.
    assert current.count() == 60
    sources.write_sessions(current, str(tmp_path / "sessions"))
    stored = spark.read.parquet(str(tmp_path / "sessions"))
    mine = plans.user_sessions(stored, "user_000003").collect()
    assert [r.session_id for r in mine] == ["sess_63", "sess_93"]
    assert plans.converted_sessions(stored, limit=50).count() == 12
    shares = plans.device_distribution(stored).collect()
    assert [(r.device_type, r.sessions) for r in shares] == [("mobile", 40), ("desktop", 20)]
