import datetime as dt

from millgauge.plans import rollups

ORDERS = ("work_order_id string, part_number string, operation_code string, order_qty int, standard_total_hrs double, actual_total_hrs double, "
          "work_center string, due_date date, status string, is_late boolean, is_farm_out boolean")
STEPS = "routing_id string, part_number string, operation_code string, operation_sequence int, setup_time_hrs double, run_time_hrs_per_unit double"


def order(number, part="P1", code="OP-10", qty=10, hours=8.0, center="WC-MILL", due=dt.date(2024, 3, 1), status="Complete", late=False, out=False):
    return (f"WO-{number}", part, code, qty, hours, hours, center, due, status, late, out)


def test_routing_of_orders(spark):
    steps = [("R2", "P1", "OP-20", 20, 2.0, 0.2), ("R1", "P1", "OP-10", 10, 1.0, 0.1), ("R1b", "P1", "OP-10", 10, 9.0, 9.0), ("R3", None, "OP-10", 10, 5.0, 5.0),
             ("R4", "P2", None, 10, None, 1.0)]
    orders = [order(1), order(2, code="OP-20"), order(3, code="OP-99"), order(4, code=None), order(5, part="P9"), order(6, part=None), order(7, part="P2", code=None),
              order(8, qty=None)]
    found = rollups.with_routing(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(steps, STEPS))
    got = {int(r.work_order_id[3:]): (r.routing_match, r.routing_hrs) for r in found.collect()}
    assert got == {1: ("operation", 2.0), 2: ("operation", 4.0), 3: ("part", 2.0), 4: ("part", 2.0), 5: ("none", None), 6: ("none", None),
                   7: ("part", None), 8: ("operation", None)}
    assert rollups.with_routing(spark.createDataFrame(orders, ORDERS), spark.createDataFrame([], STEPS)).count() == len(orders)


def test_a_years_rate_is_that_of_its_orders(spark):
    orders = [order(k) for k in range(8)] + [order(9, due=dt.date(2024, 4, 1), late=True), order(10, due=dt.date(2024, 4, 2), center=None, status="Open")]
    orders.append(order(11, due=None))
    rows = {(r.grouping_id, r.period_month and r.period_month.month, r.work_center): r for r in rollups.kpi_rollup(spark.createDataFrame(orders, ORDERS)).collect()}
    assert rows[0, 3, "WC-MILL"].on_time_delivery_pct == 100.0 and rows[0, 4, "WC-MILL"].on_time_delivery_pct == 0.0
    assert rows[0, 4, None].total_orders == 1 and rows[1, 4, None].total_orders == 2
    assert rows[3, None, None].on_time_delivery_pct == 88.9 and rows[7, None, None].total_orders == 10
    assert rows[7, None, None].completed_hrs == 72.0
