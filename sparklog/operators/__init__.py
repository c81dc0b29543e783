"""What is done with lines: parsing, attaching, filtering, looking, detecting, inferring."""
