"""softseg: soft behavioural segmentation of event data on PySpark."""
