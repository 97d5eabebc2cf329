"""Tables in, and the views that turn the test tables into panels, graphs and labels."""
