"""tidebar: order-flow research and corpus preparation as Spark DataFrame jobs."""
