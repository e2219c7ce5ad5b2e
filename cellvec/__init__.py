"""Cities as vectors on Spark: grids, densities, clusters and reports of many cities in one job."""
