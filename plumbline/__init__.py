"""plumbline: integrity analytics over keyed tables and content-addressed stores, on Spark."""
