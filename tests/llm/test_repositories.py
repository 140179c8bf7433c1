from wardspark.llm.secret_scan import secret_report, secret_scan


def test_an_example_repeated_by_one_owner_is_not_live(spark):
    rows = [(i, "hot", "secret = kT9vQ2xL7mB4wZ8p") for i in range(10)] + [(100 + i, f"src{i % 2}", "token: uY3nR6cJ1hD5sF0g password=qW8eR5tY2uI9oP4a" if i else "token: uY3nR6cJ1hD5sF0g") for i in range(9)]
    rows += [(200, "hot", "nothing")]
    found = {r.doc_id: r for r in secret_report(secret_scan(spark.createDataFrame(rows, "doc_id long, source string, text string"))).collect()}
    assert all((found[i].n_repeated, found[i].n_live, found[i].held_by) == (1, 0, "10:1") for i in range(10))
    assert (found[100].n_shared, found[100].n_repeated, found[100].held_by) == (1, 0, "9:2") and found[101].held_by == "9:2,8:2"
    assert found[200].held_by == ""
