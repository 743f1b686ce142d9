"""Run-history analytics for fleets of containerised step graphs, as Spark DataFrame operators."""
