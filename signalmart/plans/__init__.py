"""Silver and gold tables, reports and the batch jobs that write them."""
